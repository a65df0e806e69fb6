"""Best-fit packing of tokenised documents into fixed-size sequences.

Pattern packing by non-negative least squares: the histogram of piece lengths
(at most ``capacity`` numbers, whatever the input) goes to the driver, where
patterns of two to four lengths that fill a sequence exactly are enumerated
and their repeat counts fitted to the histogram with ``x >= 0``.  Counts are
rounded down to what the histogram holds; the residual lengths are packed best
fit, longest first, on the histogram as well, so the plan is a bounded table
of "pieces number r to r+n of length L go to sequences s to s+n at offset o".

Every piece then finds its place alone: its number among the pieces of its
length is its number within its task plus that of the tasks before, and a
binary search in the broadcast plan (bounded by the capacity, not by the
input) gives sequence and offset.  No group, hot length included, is ever
gathered.

Edge cases: a null text counts as empty and becomes the end-of-document id
alone; documents longer than the capacity are cut into full pieces and a rest;
repeated rows, null ids and ties are packed row by row; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicata.llm.common import cut, slices
from indicata.llm.forms import FormMemory

CAPACITY = 4096
END_ID = 1
DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Word forms that a worker remembers, and the longest form it remembers.
CACHE_FORMS = 600_000
CACHE_CHARS = 48
_SLICE_BYTES = 1 << 22
#: Forms of small letters that are one word to the splitter, and are in composed form.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_TAILS = ".,"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte that is not printable ASCII or Latin."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_letters()
_TOKENIZERS: dict[str, "WordTokenizer"] = {}


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file: ``path``, or the installed public vocabulary."""
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(DEFAULT_VOCABULARY)


class WordTokenizer:
    """A ``tokenizers`` file whose merges never cross white space.

    Such a vocabulary gives a text the concatenated ids of its space-separated
    forms, each of which is encoded once (``FormMemory``).  Letters A-Z may be lowered before, as the file's
    normaliser lowers them anyway; texts that may hold a special token
    (``<|``) are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not ((spec.get("normalizer") or {}).get("normalizers") or [{}])[-1].get("type") == "Lowercase":
            raise ValueError("the vocabulary must lower-case its text")
        self._encoder = Tokenizer.from_str(json.dumps(spec))
        # the merges alone, for forms that normaliser and splitter leave whole
        self._merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None}))
        self._memory = FormMemory(self._learn, CACHE_FORMS, CACHE_CHARS)

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    @staticmethod
    def _batch(encoder, forms: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in encoder.encode_batch_fast(forms, add_special_tokens=False)]

    def _learn(self, forms: list[str]) -> dict[str, bytes]:
        """Ids of forms that are not remembered; ``word,`` is ``word`` and ``,``."""
        known, out, tailed, whole, rest = self._memory.known, {}, [], set(), set()
        for f in forms:
            stem = f[:-1]
            if f[-1] in _TAILS and _PLAIN.fullmatch(stem):
                tailed.append(f)
                rest.add(f[-1])
                f = stem
            if f in known:
                continue
            (whole if _PLAIN.fullmatch(f) else rest).add(f)
        rest = [f for f in rest if f not in known]
        whole = list(whole)
        out.update(zip(rest, self._batch(self._encoder, rest)))
        out.update(zip(whole, self._batch(self._merges, [
            f if f.isascii() else f.encode().decode("latin-1").translate(_BYTES) for f in whole])))
        for f in tailed:
            stem, tail = f[:-1], f[-1]
            out[f] = (out[stem] if stem in out else known[stem]) + (out[tail] if tail in out else known[tail])
        return out

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit."""
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        low = pc.ascii_lower(pc.if_else(pa.array(special), "", texts))
        for white in "\n\t\r":
            low = pc.replace_substring(low, white, " ")
        flat, starts = self._memory.ids(low)
        starts = starts.tolist()
        out = [flat[x:y].tobytes() for x, y in zip(starts, starts[1:])]
        for k in np.flatnonzero(special):
            out[k] = self._batch(self._encoder, [texts[int(k)].as_py()])[0]
        return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           path: str | None = None, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, task (and ids, if kept)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long, task int"
    names = ["id", "piece", "start", "length", "ids_crc32", "task"]
    if keep_ids:
        schema, names = schema + ", ids array<int>", names + ["ids"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer.of(vocabulary(path))
        task = TaskContext.get().partitionId()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for i, j in slices(pc.binary_length(texts).to_pylist(), _SLICE_BYTES):
                owner, number, start, length, crc, ids = [], [], [], [], [], []
                for k, raw in enumerate(encode(texts.slice(i, j - i)), i):
                    raw += end
                    for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at:at + 4 * capacity]
                        owner.append(k)
                        number.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(np.frombuffer(part, "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array([task] * len(owner), pa.int32())]
                    + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names=names)

    return rows.mapInArrow(run, schema)


# --- the plan, from the histogram alone -----------------------------------

def patterns(lengths: np.ndarray, capacity: int, limit: int = 60_000) -> np.ndarray:
    """Rows of four lengths (0: none) that add up to ``capacity`` exactly.

    All pairs; triples and fours over evenly spread first members, so many
    that the enumeration stays below ``limit`` rows.
    """
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = False
    ls = np.flatnonzero(have)
    if not ls.size:
        return np.zeros((0, 4), np.int64)
    found = []
    a = ls[ls * 2 <= capacity]
    a = a[have[capacity - a]]
    found.append(np.stack([capacity - a, a, 0 * a, 0 * a], 1))

    def spread(n: int) -> np.ndarray:
        return ls[np.unique(np.linspace(0, ls.size - 1, min(n, ls.size)).astype(int))]

    firsts, seconds = spread(400), spread(200)
    x, y = (g.ravel() for g in np.meshgrid(firsts, seconds))
    z = capacity - x - y
    ok = (x >= y) & (y >= z) & (z > 0)
    x, y, z = x[ok], y[ok], z[ok]
    ok = have[z]
    found.append(np.stack([x[ok], y[ok], z[ok], 0 * z[ok]], 1))
    part = spread(48)
    x, y, z = (g.ravel() for g in np.meshgrid(part, part, part))
    w = capacity - x - y - z
    ok = (x >= y) & (y >= z) & (z >= w) & (w > 0)
    x, y, z, w = x[ok], y[ok], z[ok], w[ok]
    ok = have[w]
    found.append(np.stack([x[ok], y[ok], z[ok], w[ok]], 1))
    out = np.concatenate(found)
    return out[np.unique(np.linspace(0, len(out) - 1, min(limit, len(out))).astype(int))] if len(out) else out


def fit_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares ``min |A x - histogram|`` by accelerated projected gradient.

    ``A`` has a column per pattern with how often it uses each length; it is
    never formed: products are gathers and weighted bincounts.  Lengths weigh
    by their token share, as long pieces are the hard ones to place.
    """
    if not len(rows):
        return np.zeros(0)
    size = histogram.size
    used = rows > 0
    weight = np.where(histogram > 0, np.arange(size) / size, 1.0)
    flat, own = rows[used], np.nonzero(used)[0]

    def ax(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=x[own], minlength=size)

    def at(r: np.ndarray) -> np.ndarray:
        return np.bincount(own, weights=r[flat], minlength=len(rows))

    v = np.ones(len(rows))
    for _ in range(12):  # largest eigenvalue of A'WA, for the step
        v = at(weight * ax(v))
        step = np.linalg.norm(v)
        v /= step
    x = np.zeros(len(rows))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - at(weight * (ax(y) - histogram)) / (1.05 * step))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


@dataclass(frozen=True)
class Plan:
    """Runs sorted by (length, first): pieces ``first`` onward of ``length``.

    Of a run, ``per`` consecutive pieces lie in one sequence, from ``offset``
    on; the run's sequences count up from ``base``.
    """

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.int64) << 48 | self.first
        at = np.searchsorted(key, length.astype(np.int64) << 48 | number, side="right") - 1
        nth = number - self.first[at]
        return self.base[at] + nth // self.per[at], self.offset[at] + nth % self.per[at] * length


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Where the pieces counted in ``histogram`` (index: length) go."""
    left = histogram.astype(np.int64).copy()
    groups: list[tuple[int, tuple]] = []  # (sequences, ((length, how many each), ...))
    if left[capacity]:
        groups.append((int(left[capacity]), ((capacity, 1),)))
        left[capacity] = 0
    rows = patterns(np.flatnonzero(left), capacity)
    x = fit_counts(rows, left.astype(float))
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        parts = [(int(p), int((rows[i] == p).sum())) for p in np.unique(rows[i]) if p]
        n = min([int(round(x[i])), *(int(left[p]) // k for p, k in parts)])
        if n > 0:
            for p, k in parts:
                left[p] -= n * k
            groups.append((n, tuple(reversed(parts))))
    groups += _best_fit(left, capacity)

    length, first, per, base, offset = [], [], [], [], []
    taken, sequences = np.zeros(capacity + 1, np.int64), 0
    for n, parts in groups:
        at = 0
        for p, k in parts:
            length.append(p)
            first.append(int(taken[p]))
            per.append(k)
            base.append(sequences)
            offset.append(at)
            taken[p] += n * k
            at += p * k
        sequences += n
    order = np.lexsort((first, length))
    return Plan(*(np.array(c, np.int64)[order] for c in (length, first, per, base, offset)), sequences)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """Best fit, longest first, on counts: equal open sequences move as one group."""
    open_: dict[int, list[tuple[int, tuple]]] = {}
    gaps: list[int] = []

    def put(gap: int, n: int, parts: tuple) -> None:
        if n <= 0:
            return
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append((n, parts))

    for p in range(capacity, 0, -1):
        c = int(left[p])
        while c:
            i = bisect.bisect_left(gaps, p)
            if i == len(gaps):
                k = capacity // p
                put(capacity - k * p, c // k, ((p, k),))
                if c % k:
                    put(capacity - c % k * p, 1, ((p, c % k),))
                break
            gap = gaps[i]
            n, parts = open_[gap].pop()
            if not open_[gap]:
                del open_[gap], gaps[i]
            k = gap // p
            full = min(n, c // k)
            put(gap - k * p, full, (*parts, (p, k)))
            c -= full * k
            n -= full
            if n and 0 < c < k:
                put(gap - c * p, 1, (*parts, (p, c)))
                c, n = 0, n - 1
            put(gap, n, parts)
    return [g for gap in gaps for g in open_[gap]]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         path: str | None = None, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of every row with sequence_id and offset; token ids too if ``keep_ids``."""
    spark = docs.sparkSession
    found = cut(pieces(docs, id_col, text, capacity, path, end_id, keep_ids))
    per_task = cut(found.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[r["length"]] = r["n"]
    sent = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = per_task.select("task", "length", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("task", "length").orderBy("id", "piece", "ids_crc32"))
    numbered = (found.withColumn("nth", within - 1).join(before, ["task", "length"])
                .withColumn("nth", F.col("nth") + F.col("before")).drop("before", "task"))
    schema = T.StructType([*numbered.drop("nth").schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    names = [f.name for f in schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, off = sent.value.place(batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            rest = [c for n, c in zip(batch.schema.names, batch.columns) if n != "nth"]
            yield pa.RecordBatch.from_arrays(rest + [pa.array(seq), pa.array(off)], names=names)

    return numbered.mapInArrow(run, schema)


def packed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(docs).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                             "sequence_id", "offset")
