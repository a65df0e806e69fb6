"""Order MinHash: document fingerprints that are sensitive to edit distance.

A text is the sequence of its k-mers of code points, each numbered by how often
the same k-mer occurred before.  Every hash function picks the ``SELECT``
numbered k-mers of smallest hash; put back in text order they are hashed as a
tuple to one 32-bit signature.  Two texts agree in a signature with a
probability that falls with their edit distance, not only with their overlap.

``edit_report`` compares each document with an edited text and its successor.
Documents are dealt by range of doc_id and sorted inside the tasks, so each
task meets a document and its successor in one stream; only the first and the
last row of each task are matched by a join of two rows per task.

Edge cases: a null text counts as empty; a text shorter than a k-mer is one
k-mer, an empty one has the fingerprint of no k-mer; documents are ordered by
descending doc_id, nulls last, ties by the text's hash; a single document follows itself;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicata.llm.common import cut

#: Code points per k-mer (a power of two), k-mers per tuple, signatures.
K, SELECT, SIGNATURES = 8, 2, 64
_COLUMNS = 1 << 14
_POSITION_BITS = 20


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_SEEDS = _mix(np.arange(1, SIGNATURES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
_ODD = _mix(_SEEDS) | np.uint64(1)


def _sorted_places(h: np.ndarray) -> np.ndarray:
    """``np.argsort(h, kind="stable")``, by one sort of (high bits, position) words where that gives the same.

    It does not where the position leaves too few bits for all hashes to differ
    in the others; then all 64 bits are sorted by.
    """
    if h.size < 1 << _POSITION_BITS:
        low = np.uint64((1 << _POSITION_BITS) - 1)
        at = (np.sort((h & ~low) | np.arange(h.size, dtype=np.uint64)) & low).astype(np.int64)
        key = h[at]
        differ = key[1:] ^ key[:-1]
        if not ((differ > 0) & (differ <= low)).any():
            return at
    return np.argsort(h, kind="stable")


def numbered_kmers(text: str, k: int = K) -> np.ndarray:
    """Hash of each k-mer of ``text`` together with its occurrence number, in text order."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if h.size < k:
        h = np.array([int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                                     "little")], np.uint64) if h.size else h
    else:
        width = 1
        while width < k:  # hashes of 1, 2, 4, ... code points
            h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
            h ^= h >> np.uint64(29)
            width *= 2
    h = _mix(h)
    if h.size < 2:
        return h
    at = _sorted_places(h)
    key = h[at]
    same = key[1:] == key[:-1]
    if same.any():
        first = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(h.size), 0))
        occurrence = np.empty(h.size, np.uint64)
        occurrence[at] = (np.arange(h.size) - first).astype(np.uint64)
        repeated = occurrence > 0
        h[repeated] = _mix(h[repeated] + occurrence[repeated] * np.uint64(0xD6E8FEB86659FD93))
    return h


def signatures(text: str) -> np.ndarray:
    """The ``SIGNATURES`` 32-bit signatures of ``text``."""
    h = numbered_kmers(text)
    if not h.size:
        return np.zeros(SIGNATURES, np.uint32)
    take = min(SELECT, h.size)
    values, places = [], []
    for i in range(0, h.size, _COLUMNS):
        part = (h[None, i:i + _COLUMNS] ^ _SEEDS) * _ODD
        for _ in range(min(take, part.shape[1])):
            best = part.argmin(axis=1)[:, None]
            values.append(np.take_along_axis(part, best, 1))
            places.append(best + i)
            np.put_along_axis(part, best, np.uint64(2 ** 64 - 1), 1)
    value, place = np.concatenate(values, 1), np.concatenate(places, 1)
    if value.shape[1] > take:
        chosen = np.argsort(value, axis=1, kind="stable")[:, :take]
        place = np.take_along_axis(place, chosen, 1)
    place.sort(axis=1)
    out = np.zeros(SIGNATURES, np.uint64)
    for column in place.T:
        out = _mix(out * np.uint64(31) + h[column])
    return (out >> np.uint64(32)).astype(np.uint32)


def _packed(signature: np.ndarray) -> bytes:
    return signature.astype(">u4").tobytes()


def as_text(signature: np.ndarray) -> str:
    return _packed(signature).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal signatures."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) of every row: the signatures in hexadecimal."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([as_text(signatures(t or "")) for t in batch.column(1).to_pylist()],
                                           pa.string())], names=["id", "fingerprint"])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType),
                                              T.StructField("fingerprint", T.StringType())]))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _report(doc_id, text: str, own: np.ndarray, following: str, next_own: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = signatures(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
            _packed(own), _packed(other), likeness(own, other), likeness(own, next_own))


_REPORT = (("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()),
           ("fingerprint", T.BinaryType()), ("edited_fingerprint", T.BinaryType()),
           ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the range bounds that Spark samples to the driver hold an id and a hash, never a text
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("t")]
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
            .repartitionByRange(parts, *order).sortWithinPartitions(*order, "t"))
    schema = T.StructType([T.StructField(n, t) for n, t in _REPORT + (
        ("task", T.IntegerType()), ("edge", T.StringType()), ("t", T.StringType()))])

    def table_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * len(schema)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, _ARROW[f.dataType.simpleString()]) for c, f in zip(columns, schema)], names=schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), None
        blank = (None,) * 6
        for batch in batches:
            found = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = signatures(text)
                if before is None:
                    found.append((doc_id, *blank, task, "first", text))
                else:
                    found.append((*_report(*before, text, own), task, None, None))
                before = (doc_id, text, own)
            yield table_of(found)
        if before is not None:
            yield table_of([(before[0], *blank, task, "last", before[1])])

    found = cut(rows.mapInArrow(run, schema))
    inside = found.where("edge is null").select("doc_id", *schema.names[1:7])
    # two rows per task remain: the last row of a task is followed by the first of the next one with rows
    tasks = sorted(r["task"] for r in found.where("edge = 'first'").select("task").collect())
    follows = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1])), "task int, after int")
    last = found.where("edge = 'last'").select("doc_id", "t", "task")
    first = found.where("edge = 'first'").select(F.col("task").alias("after"), F.col("t").alias("following"))
    ends = last.join(follows, "task").join(first, "after").select("doc_id", "t", "following")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.names[:7]
        for batch in batches:
            out = [_report(i, t, signatures(t), n, signatures(n)) for i, t, n in zip(*(c.to_pylist() for c in batch.columns))]
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, _ARROW[f.dataType.simpleString()]) for c, f in zip(columns, schema)], names=names)

    out = inside.unionByName(ends.mapInArrow(finish, T.StructType(schema.fields[:7])))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
