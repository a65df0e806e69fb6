"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of every labelled row inside the tasks,
sums them with one shuffle of (label, bucket, count) rows, and leaves a
log-probability matrix of ``buckets x labels`` floats, which is the only thing
broadcast (``MAX_LABELS`` bounds it).  Scoring is one vectorised pass per
Arrow batch: each n-gram start of the batch becomes a column index of a sparse
row, and a segment sum over the gathered log-probabilities is the sparse
product.

Edge cases: a null text, an empty one and one without a letter are ``und``
with score 0; ties go to the label that sorts first; a model learned from no
labelled row answers ``und`` everywhere; repeated rows count as often as they
occur; other columns are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicata.llm.common import SLICE_CHARS, fresh_name, slices

UNDETERMINED = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_LABELS = 1000


@dataclass(frozen=True)
class Model:
    """``log_prob`` has a row per label, a last column of zeros for "no n-gram"."""

    labels: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, 32 for the rest."""
    out = np.full(0x10000, 32, np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _code_points(text: str) -> np.ndarray:
    """Letters in lower case, anything else as a space, a space on either side."""
    raw = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    if raw.size and raw.max() > 0xFFFF:
        out = _letters()[np.minimum(raw, 0xFFFF)]
        for cp in np.unique(raw[raw > 0xFFFF]):
            out[raw == cp] = cp if chr(cp).isalpha() else 32
        return out
    return _letters()[raw]


def _ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """(has a letter, start of each text, one array of bucket numbers per order).

    Starts whose n-gram would leave its text carry the number ``BUCKETS``.
    """
    parts = [_code_points(t) for t in texts]
    sizes = np.array([p.size for p in parts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    cps = np.concatenate(parts)
    lettered = np.add.reduceat(cps != 32, starts) > 0

    def orders() -> Iterator[np.ndarray]:
        h = np.zeros(cps.size, np.uint32)
        for n in range(1, max(ORDERS) + 1):
            tail = cps[n - 1:]
            h = (h[:tail.size] * np.uint32(0x01000193)) ^ (tail + np.uint32(n))
            if n not in ORDERS:
                continue
            mixed = h * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA77)
            out = np.full(cps.size, BUCKETS, np.int64)
            out[:tail.size] = mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)
            for k in range(1, n):
                out[ends - k] = BUCKETS
            yield out

    return lettered, starts, orders()


def _pieces(text: str) -> list[str]:
    """A long text in pieces of bounded size (an n-gram never spans two of them)."""
    if len(text) <= SLICE_CHARS:
        return [text]
    return [text[i:i + SLICE_CHARS] for i in range(0, len(text), SLICE_CHARS)]


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        by_label: dict[str, list[str]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_label.setdefault(label, []).extend(_pieces(text))
            rows[label] = rows.get(label, 0) + 1
        for label, texts in by_label.items():
            counts = held.setdefault(label, np.zeros(BUCKETS + 1, np.int64))
            for i, j in slices([len(t) for t in texts]):
                for idx in _ngrams(texts[i:j])[2]:
                    counts += np.bincount(idx, minlength=BUCKETS + 1)
    for label, counts in held.items():
        counts[BUCKETS] = rows[label]  # the spare cell carries the number of rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([label] * at.size, pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])],
            names=["label", "bucket", "n"])


def train(docs: DataFrame, text: str = "text", label: str = "lang", alpha: float = 0.5) -> Model:
    """Fit the model on every row of ``docs`` with a text and a label.

    The driver receives ``labels x BUCKETS`` sums whatever the input's size;
    more than ``MAX_LABELS`` labels is an error, not a cut.
    """
    known = docs.select(F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("l")).where(
        "t is not null and l is not null")
    sums = (known.mapInArrow(_count_batches, "label string, bucket int, n long")
            .groupBy("label", "bucket").agg(F.sum("n").alias("n")))
    # one row per label: the sums travel as one array pair, not as single rows
    packed = sums.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).limit(MAX_LABELS + 1)
    got = sorted(packed.collect(), key=lambda r: r["label"])
    if len(got) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} distinct labels")
    counts = np.zeros((len(got), BUCKETS + 1))
    for i, r in enumerate(got):
        cells = np.array(r["cells"], dtype=np.int64)
        counts[i, cells[:, 0]] = cells[:, 1]
    rows = counts[:, BUCKETS].copy()
    counts[:, BUCKETS] = 0
    smooth = counts[:, :BUCKETS] + alpha
    log_prob = np.zeros((len(got), BUCKETS + 1), np.float32)
    if len(got):
        log_prob[:, :BUCKETS] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return Model(tuple(r["label"] for r in got), np.log(rows / max(rows.sum(), 1)) if len(got) else rows, log_prob)


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Best label and its posterior probability for each text."""
    pieces, owner = [], []
    for i, t in enumerate(texts):
        if t:
            found = _pieces(t)
            pieces += found
            owner += [i] * len(found)
    total = np.tile(model.log_prior, (len(texts), 1)) if model.labels else np.zeros((len(texts), 0))
    lettered = np.zeros(len(texts), bool)
    own = np.array(owner, np.int64)
    for i, j in slices([len(p) for p in pieces]):
        seen, starts, orders = _ngrams(pieces[i:j])
        np.logical_or.at(lettered, own[i:j], seen)
        for idx in orders:
            for k in range(len(model.labels)):
                np.add.at(total[:, k], own[i:j],
                          np.add.reduceat(model.log_prob[k][idx], starts, dtype=np.float64))
    if not model.labels:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    best = total.argmax(axis=1)
    score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return ([model.labels[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)],
            np.where(lettered, score, 0.0))


def predict(docs: DataFrame, model: Model, text: str = "text", label_col: str = "lang_pred",
            score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted label and its probability appended, in one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = fresh_name(docs.columns, "_text")
    schema = T.StructType([*docs.schema.fields, T.StructField(label_col, T.StringType()),
                           T.StructField(score_col, T.DoubleType())])
    names = [f.name for f in schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, score = score_texts(sent.value, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(labels, pa.string()), pa.array(score)], names=names)

    return docs.withColumn(name, F.col(text).cast("string")).mapInArrow(run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``.

    Rows whose crc32 of doc_id leaves 2 modulo 4 are held out: the model
    never sees them.  A null doc_id counts as not held out.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text", "lang")
    model = train(rows.where(~F.col("held_out")))
    return (predict(rows.select("doc_id", "held_out", "text"), model)
            .select("doc_id", "held_out", "lang_pred", "score"))


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is recognised; columns unchanged."""
    label, score = fresh_name(docs.columns, "_lang_pred"), fresh_name(docs.columns, "_score")
    found = predict(docs, train(docs), label_col=label, score_col=score)
    return (found.where((F.col(label) != UNDETERMINED) & (F.col(score) >= min_score)).drop(label, score))
