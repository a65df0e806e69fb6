"""Training-data pipeline over ``documents``: language, near-duplicates, personal data, packing.

Each stage is (name, function of (spark, docs, sf_dir)); ``run`` writes what a
stage returns as Parquet in the shared folder and reads it as the next
stage's ``docs``.

1. ``language``: naive Bayes learned from the labelled rows of ``docs``; rows
   whose language is not recognised (no letter, null text, posterior below
   one half) go.
2. ``near_duplicates``: SimHash components at 4-word shingles and 4 bits; the
   row of the smallest doc_id of each component stays.
3. ``personal_data``: spans are masked in ``text``; ``n_chars`` follows.
4. ``packing``: pieces of at most 4096 tokens with their place in a sequence.

Stages 1 to 3 return the columns of ``docs``.  An empty table passes through
all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from indicata.llm import language_id, packing, pii, simhash
from indicata.llm.common import importable, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates),
          ("personal_data", personal_data), ("packing", pack)]

#: No stage can be stated in SQL (learned models, tokenizer); tests/llm/test_pipeline.py
#: holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(importable(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
