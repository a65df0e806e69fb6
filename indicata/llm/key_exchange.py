"""Which keys of a shard add up to a threshold over all shards.

A shard is a bounded piece of the corpus that one task works on at a time.
It names its distinct keys (48-bit hashes, sorted) with a weight each; the
keys are dealt by range, so a bucket's part of a shard is found by binary
search and travels as one compressed row.  A bucket adds the weights of equal
keys and answers every shard with one bit a key and threshold, in the shard's own key
order.  Keys never meet as rows, a hot key is one entry a shard, and an
answer takes a bit: what moves is about five bytes for each distinct key of a
shard.  Two keys that share a hash are taken for one, so a bit may be set
without need but never missing; callers decide exactly afterwards.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a key.
BITS = 48
KEY_MASK = np.uint64((1 << BITS) - 1)
#: Buckets for each shuffle partition.
BUCKETS_PER_PARTITION = 2

DEALT = "shard long, bucket int, n int, body binary"


@functools.cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@functools.cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return _compressor(level).compress(raw)


def unsqueeze(body: bytes) -> bytes:
    return _decompressor().decompress(body)


def planes(values: np.ndarray, keep: int) -> bytes:
    """The ``keep`` low bytes of each number, byte by byte over all numbers."""
    wide = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return wide[:, :keep].T.tobytes()


def unplanes(raw: bytes, n: int, keep: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :keep] = np.frombuffer(raw, np.uint8, n * keep).reshape(keep, n).T
    return wide.view("<u8").reshape(-1)


def bucket_count(df: DataFrame) -> int:
    return BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket_starts(buckets: int) -> np.ndarray:
    """First key of each bucket; the last entry is beyond all keys."""
    return (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(BITS - 16)) // np.uint64(buckets) << np.uint64(16)


def dealt(shard: int, keys: np.ndarray, weights: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket in which ``keys`` (sorted, distinct) lie."""
    cuts = np.searchsorted(keys, bucket_starts(buckets))
    some = np.flatnonzero(np.diff(cuts))
    bodies = [squeeze(planes(keys[s:e], 6) + planes(weights[s:e], 8))
              for s, e in zip(cuts[some].tolist(), cuts[some + 1].tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(some.size, shard, np.int64)), pa.array(some.astype(np.int32)),
         pa.array(np.diff(cuts)[some].astype(np.int32)), pa.array(bodies, pa.binary())],
        names=["shard", "bucket", "n", "body"])


def _answer(thresholds: tuple[int, ...]) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        sizes = rows.column("n").to_pylist()
        keys, weights = [], []
        for n, body in zip(sizes, rows.column("body")):
            raw = unsqueeze(body.as_py())
            keys.append(unplanes(raw, n, 6))
            weights.append(unplanes(raw[6 * n:], n, 8))
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate(weights).astype(float))[where]  # whole numbers below 2^53
        marks = [total >= t for t in thresholds]
        ends = np.cumsum(sizes)
        bits = [b"".join(np.packbits(m[e - n:e]).tobytes() for m in marks) for n, e in zip(sizes, ends)]
        return pa.table({"shard": rows.column("shard"), "bucket": rows.column("bucket"),
                         "n": rows.column("n"), "bits": pa.array(bits, pa.binary())})

    return run


def answers(keys: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """shard, ``bits``: array of (bucket, n, bits) in bucket order, for rows of ``dealt``."""
    found = keys.groupBy("bucket").applyInArrow(_answer(thresholds), "shard long, bucket int, n int, bits binary")
    return found.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "bits"))).alias("bits"))


def marks(bits: list[dict] | None, thresholds: int) -> list[np.ndarray]:
    """For each threshold, one boolean for each key of the shard, in key order."""
    out: list[list[np.ndarray]] = [[] for _ in range(thresholds)]
    for part in bits or []:
        n, raw = part["n"], np.frombuffer(part["bits"], np.uint8)
        size = -(-n // 8)
        for i in range(thresholds):
            out[i].append(np.unpackbits(raw[i * size:(i + 1) * size], count=n).astype(bool))
    return [np.concatenate(x) if x else np.zeros(0, bool) for x in out]


def per_shard(work: Callable[[dict], Iterable[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on every row (a dict) of the batches, one at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from work({c: batch.column(c)[i].as_py() for c in batch.schema.names})

    return run
