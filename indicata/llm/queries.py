"""One registered query per operator, each over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from indicata.llm import collocations, lexical_search, licenses, repeats
from indicata.llm.common import table
from indicata.llm.language_id import language_id
from indicata.llm.neighbours import nearest_vectors
from indicata.llm.order_minhash import edit_report
from indicata.llm.packing import packed_documents
from indicata.llm.pii import personal_data
from indicata.llm.pseudo_likelihood import score_corpus
from indicata.llm.sentencepiece_codec import round_trip
from indicata.llm.simhash import simhash_groups
from indicata.llm.site_style_tree import extract


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives the text back."""
    return round_trip(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known license sentences and licenses of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    return language_id(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data(table(spark, sf_dir, "documents"))


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one, among all."""
    return nearest_vectors(table(spark, sf_dir, "embeddings"))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    return score_corpus(table(spark, sf_dir, "documents"))


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return edit_report(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document's pieces in sequences of 4096 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier one has too, 50 at least in a row."""
    return repeats.repeats_report(table(spark, sf_dir, "documents"))


def op12_prefix_free_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sentencepiece, op2_license_scan, op3_language_id, op4_pii, op5_learned_partitions,
        op6_pseudo_likelihood, op7_site_style_tree, op8_simhash_near_dedup, op9_order_minhash,
        op10_best_fit_packing, op11_suffix_array_dedup, op12_prefix_free_phrases, op13_lexical_search)}

#: The other operators learn, hash or tokenise outside SQL; tests/llm holds
#: them against brute force.
ORACLE: dict[str, str] = {
    "op2_license_scan": licenses.oracle(), "op11_suffix_array_dedup": repeats.oracle(),
    "op12_prefix_free_phrases": collocations.oracle(), "op13_lexical_search": lexical_search.oracle()}
