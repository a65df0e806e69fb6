"""Repeated passages removed by suffix arrays.

``strip_repeats`` takes every whole text as UTF-8 bytes and removes each byte
covered by a ``LENGTH``-byte string that also starts in a document with a
smaller doc_id.  Strings are judged on the input, matches never cross
documents.

How it runs.
1. The documents are written once as document shards of about
   ``SHARD_BYTES``.  Every string of a text has an anchor, the smallest hash of
   the ``SEED``-byte strings in it.  Consecutive strings of one anchor form a piece;
   equal strings have equal anchors wherever they stand.
2. ``key_exchange`` tells each shard which of its anchors occur more than once
   in the corpus.  Pieces of other anchors cannot hold a repeated string
   and stay where they are.
3. The distinct pieces of a shard with a shared anchor, each with its smallest
   doc_id, are dealt by anchor.  Anchors with over ``HOT`` pieces are dealt
   string by string, by the string's own hash, so that a common seed in ever
   new surroundings does not fill one task.
4. Each bucket cuts its distinct pieces, but for those that are the only one of their
   anchor, into shards of ``SHARD_BYTES``.  A shard's
   suffix array is refined as Larsson and Sadakane do: suffixes are ordered by
   their first 8 bytes, then groups that are still tied by the ranks 8, 16, 32, ..
   further on, until none is tied.  Kasai's common
   prefixes of neighbours, taken in text order in many lanes at once, part
   the suffixes into strings, each with its smallest doc_id.  Shards of a
   bucket are merged by binary search of the one's distinct strings in
   the other's, and every piece is answered with the smallest doc_id of each of its
   strings, as runs.
5. The answers join the document shards, which mark what is covered.

What moves is some five bytes for each distinct anchor of a shard and the
pieces with shared anchors, copies within a shard folded.

Edge cases: a null or empty text has no bytes; a text shorter than ``LENGTH``
loses nothing.  Rows that repeat a doc_id do not remove from each other.  A
null doc_id counts as the largest long: its text removes nothing from
others.  An empty table gives no row.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.llm import key_exchange as kx
from indicata.llm.common import importable, written
from indicata.llm.words import expand

LENGTH = 50
#: Bytes of the strings among which an anchor is chosen; a multiple of 8.
SEED = 24
SHARD_BYTES = 2 << 20
#: Pieces of one anchor above which its strings are dealt singly.
HOT = 4096
#: Places that one pass over a text takes at a time.
_STEP = 1 << 18
#: Follows the last text: no byte of UTF-8, so no suffix is the beginning of another.
_GUARD = np.uint8(255)
#: Places walked side by side for common prefixes.
_LANES = 8192
_NULL = np.iinfo(np.int64).max

_DOCUMENTS = "shard long, ids binary, nulls binary, ends binary, body binary"
_PIECES = "shard long, bucket int, sizes binary, anchors binary, least binary, body binary"
_LEAST = "shard long, bucket int, lengths binary, least binary"
_RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
           "spans array<struct<start:long,end:long>>")


# ---- document shards -------------------------------------------------------

def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    size = 0

    def passed() -> pa.RecordBatch:
        ids = np.array([0 if i is None else i for i, _ in held], "<i8")
        nulls = np.array([i is None for i, _ in held], np.uint8)
        ends = np.cumsum([len(t) for _, t in held]).astype("<i8")
        body = kx.squeeze(b"".join(t for _, t in held), 3)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, nulls, ends)),
             pa.array([body], pa.binary())], names=["shard", "ids", "nulls", "ends", "body"])

    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1)):
            raw = (text.as_py() or "").encode()
            if held and size + len(raw) > SHARD_BYTES:
                yield passed()
                held, size, number = [], 0, number + 1
            held.append((i.as_py(), raw))
            size += len(raw)
    if held:
        yield passed()


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, first byte highest; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    out = np.empty(text.size, np.uint64)
    for i in range(8):
        own = out[i::8]
        own[:] = np.frombuffer(padded, ">u8", own.size, i)
    return out


def anchors(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Anchor of the string that starts at each place (48 bits)."""
    places = text.size - length + 1
    out = np.empty(max(places, 0), np.uint64)
    for at in range(0, max(places, 0), _STEP):
        part = text[at:at + min(_STEP, places - at) + length - 1]
        word = _words(part)
        n = part.size - SEED + 1
        h = np.zeros(n, np.uint64)
        for i in range(0, SEED, 8):
            h = (h ^ word[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h = h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - kx.BITS)
        width, wanted = 1, length - SEED + 1
        while width < wanted:  # least of ``width`` neighbours, doubled until all are in
            step = min(width, wanted - width)
            h = np.minimum(h[:h.size - step], h[step:])
            width += step
        out[at:at + h.size] = h
    return out


def _spread(anchor: np.ndarray) -> np.ndarray:
    """Least hashes lie at the low end; multiplied and folded one to one they lie evenly over the buckets."""
    for odd in (0x9E3779B97F4B, 0xC2B2AE3D27D5):
        anchor = anchor * np.uint64(odd) & kx.KEY_MASK
        anchor = anchor ^ anchor >> np.uint64(kx.BITS // 2)
    return anchor


class Documents:
    """A document shard and its pieces."""

    def __init__(self, row: dict, length: int):
        self.number, self.length = row["shard"], length
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.null = np.frombuffer(row["nulls"], np.uint8).astype(bool)
        self.rank = np.where(self.null, _NULL, self.ids)
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.text = np.frombuffer(kx.unsqueeze(row["body"]), np.uint8)
        starts = self.ends - np.diff(self.ends, prepend=0)
        anchor, first, doc = [], [], []
        for i, (s, e) in enumerate(zip(starts.tolist(), self.ends.tolist())):
            if e - s >= length:
                a = anchors(self.text[s:e], length)
                new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                anchor.append(_spread(a[new]))
                first.append(np.append(new, a.size) + s)
                doc.append(np.full(new.size, i))
        # piece p of document doc[p] holds the strings that start at first[p] to last[p] - 1
        self.anchor = np.concatenate(anchor) if anchor else np.zeros(0, np.uint64)
        self.first = np.concatenate([f[:-1] for f in first]) if first else np.zeros(0, np.int64)
        self.last = np.concatenate([f[1:] for f in first]) if first else np.zeros(0, np.int64)
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        keys, count = np.unique(self.anchor, return_counts=True)
        return keys, count.astype(np.uint64)

    def shared(self, bits: list[dict] | None, buckets: int) -> SharedPieces:
        twice, hot = kx.marks(bits, 2)
        keys, where = np.unique(self.anchor, return_inverse=True)
        return SharedPieces(self, np.flatnonzero(twice[where]), hot[where], buckets)


class SharedPieces:
    """The distinct pieces of a shard that others may hold too, by bucket."""

    def __init__(self, docs: Documents, pieces: np.ndarray, hot: np.ndarray, buckets: int):
        text, tail = docs.text.tobytes(), docs.length - 1
        starts = kx.bucket_starts(buckets)
        home = np.searchsorted(starts, docs.anchor[pieces], "right") - 1
        found: dict[bytes, int] = {}
        self.bodies: list[bytes] = []
        self.least: list[int] = []
        self.bucket: list[int] = []
        self.anchor: list[int] = []
        #: document, first string and number of strings of every use of a piece, and which piece it is
        uses: list[tuple[int, int, int, int]] = []

        def use(doc: int, s: int, e: int, b: int | None, anchor: int) -> None:
            body = text[s:e + tail]
            at = found.get(body)
            if at is None:
                at = found[body] = len(self.bodies)
                self.bodies.append(body)
                self.least.append(_NULL)
                if b is None:  # a string dealt by itself
                    anchor = crc32(body)
                    b, anchor = anchor % buckets, anchor + (1 << kx.BITS)
                self.bucket.append(b)
                self.anchor.append(anchor)
            if rank[doc] < self.least[at]:
                self.least[at] = rank[doc]
            uses.append((doc, s, e - s, at))

        rank = docs.rank.tolist()
        for p, doc, s, e, b, a in zip(pieces.tolist(), docs.doc[pieces].tolist(), docs.first[pieces].tolist(),
                                      docs.last[pieces].tolist(), home.tolist(), docs.anchor[pieces].tolist()):
            if hot[p]:
                for i in range(s, e):
                    use(doc, i, i + 1, None, a)
            else:
                use(doc, s, e, b, a)
        self.uses = np.array(uses, np.int64).reshape(-1, 4)
        #: pieces in the order in which they travel: by bucket, then as found
        self.order = np.argsort(np.array(self.bucket, np.int64), kind="stable")
        self.sizes = np.array([len(b) for b in self.bodies], np.int64)

    def rows(self, number: int) -> pa.RecordBatch:
        bucket = np.array(self.bucket, np.int64)[self.order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if bucket.size else np.zeros(0, np.int64)
        out = []
        for s, e in zip(first, np.append(first[1:], bucket.size)):
            own = self.order[s:e].tolist()
            out.append((kx.squeeze(self.sizes[own].astype("<u4").tobytes()),
                        kx.squeeze(kx.planes(np.array([self.anchor[i] for i in own], np.uint64), 7)),
                        kx.squeeze(np.array([self.least[i] for i in own], "<i8").tobytes()),
                        kx.squeeze(b"".join([self.bodies[i] for i in own]), 3)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(first.size, number, np.int64)), pa.array(bucket[first].astype(np.int32)),
             *(pa.array([r[i] for r in out], pa.binary()) for i in range(4))],
            names=["shard", "bucket", "sizes", "anchors", "least", "body"])


# ---- suffix arrays of dealt pieces ----------------------------------------

def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes; ``text`` ends with a byte that it has nowhere else.

    Larsson and Sadakane's refinement: the order by 8 bytes is refined by
    the ranks 8, 16, 32, .. places on, and only where a rank is still shared.
    """
    word = _words(text)
    order = np.argsort(word)
    sorted_ = word[order]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]] if order.size else np.zeros(0, bool)
    rank = np.empty(text.size + 1, np.int64)
    rank[-1] = -1  # beyond the end
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    h = 8
    while True:
        # places in groups of more than one: neither a start followed by a start, nor the last alone
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not tied.size:
            break
        places = order[tied]
        group = rank[places]
        after = rank[np.minimum(places + h, text.size)] + 1
        again = np.argsort(group * np.int64(text.size + 2) + after)
        places, group, after = places[again], group[again], after[again]
        order[tied] = places  # groups are runs and stay where they are
        new[tied] = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        start = np.maximum.accumulate(np.where(new[tied], tied, -1))
        rank[places] = start
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix in ``order`` shares with the one before it, ``length`` at most.

    Kasai's walk: in text order the common prefix shrinks by one at most from
    place to place, so it goes on from the last.  Lanes of consecutive places
    are walked side by side, each from nothing.  Bytes are compared eight at a
    time.
    """
    n = text.size
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    word = np.concatenate([_words(text), np.zeros(length + 16, np.uint64)])
    out = np.zeros(n, np.int64)
    lanes = min(_LANES, max(n, 1))
    first = np.arange(lanes) * n // lanes
    end = np.append(first[1:], n)
    had = np.zeros(lanes, np.int64)
    for step in range(int((end - first).max(initial=0))):
        at = first + step
        live = np.flatnonzero(at < end)
        p = at[live]
        q = before[p]
        h = np.maximum(had[live] - 1, 0)
        todo = np.flatnonzero(q >= 0)
        while todo.size:
            i, j = p[todo] + h[todo], q[todo] + h[todo]
            differ = word[i] ^ word[j]
            same = _equal_bytes(differ)
            # zeros stand beyond the end: what is left of the text bounds the prefix
            h[todo] += np.minimum(same, n - np.maximum(i, j))
            todo = todo[(same == 8) & (h[todo] < length) & (np.maximum(i, j) + 8 <= n)]
        h[q < 0] = 0
        out[p] = had[live] = np.minimum(h, length)
    return out[order]


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """Leading zero bytes of each number."""
    out = np.zeros(differ.size, np.int64)
    for i in range(8):
        out += differ >> np.uint64(56 - 8 * i) == 0
    return out


class Strings:
    """Distinct strings of some pieces in byte order, each with its smallest doc_id."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int):
        starts = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        text = np.append(text, _GUARD)
        at = expand(starts, count)
        order = suffix_array(text)
        kind = np.empty(text.size, np.int64)
        kind[order] = np.cumsum(common_prefixes(text, order, length) < length)
        kind = kind[at]
        one = np.full(int(kind.max()) + 1, -1)
        one[kind] = at  # any place of each string that is whole
        whole = one >= 0
        self.where = (np.cumsum(whole) - 1)[kind]
        self.least = np.full(int(whole.sum()), _NULL)
        np.minimum.at(self.least, self.where, np.repeat(least, count))
        rows = np.lib.stride_tricks.sliding_window_view(text, length)[one[whole]]
        self.strings = np.ascontiguousarray(rows).view(f"S{length}").ravel()

    def merge(self, other: Strings) -> None:
        """Both learn the smaller doc_id of the strings that both hold."""
        at = np.searchsorted(self.strings, other.strings)
        at[at == self.strings.size] = 0
        both = np.flatnonzero(self.strings[at] == other.strings)
        least = np.minimum(self.least[at[both]], other.least[both])
        self.least[at[both]] = other.least[both] = least


def _resolve(length: int):
    """Pieces of a bucket -> for each source shard, the smallest doc_ids of its strings as runs."""

    def run(rows: pa.Table) -> pa.Table:
        # equal pieces of several shards are one
        found: dict[bytes, int] = {}
        known: list[int] = []
        anchor: list[int] = []
        used = []
        for row in rows.to_pylist():
            sizes = np.frombuffer(kx.unsqueeze(row["sizes"]), "<u4").astype(np.int64)
            body, at, own = kx.unsqueeze(row["body"]), 0, []
            for end, a, rank in zip(np.cumsum(sizes).tolist(), kx.unplanes(kx.unsqueeze(row["anchors"]), sizes.size, 7).tolist(),
                                    np.frombuffer(kx.unsqueeze(row["least"]), "<i8").tolist()):
                piece = found.setdefault(body[at:end], len(found))
                if piece == len(known):
                    known.append(rank)
                    anchor.append(a)
                elif rank < known[piece]:
                    known[piece] = rank
                own.append(piece)
                at = end
            used.append(np.array(own))
        sizes, least = np.fromiter(map(len, found), np.int64, len(found)), np.array(known)
        of_string = np.repeat(least, sizes - length + 1)
        # the strings of a piece that no other piece shares its anchor with are its alone
        _, where, times = np.unique(np.array(anchor), return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(times[where] > 1)
        bodies = list(found)
        ends, shards, s = np.cumsum(sizes[mixed]), [], 0
        while s < mixed.size:  # as many pieces as fit, one at least
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + SHARD_BYTES, "right")))
            text = np.frombuffer(b"".join([bodies[i] for i in mixed[s:e].tolist()]), np.uint8)
            shards.append(Strings(text, sizes[mixed[s:e]], least[mixed[s:e]], length))
            s = e
        for k, shard in enumerate(shards):
            for other in shards[:k]:
                other.merge(shard)
        for k, shard in enumerate(shards):  # what later shards have learned reaches the earlier ones
            for other in shards[k + 1:]:
                shard.merge(other)
        if shards:
            of_string[np.repeat(times[where] > 1, sizes - length + 1)] = np.concatenate([x.least[x.where] for x in shards])
        count = sizes - length + 1
        start = np.cumsum(count) - count
        out = []
        for own in used:
            told = of_string[expand(start[own], count[own])]
            first = np.flatnonzero(np.r_[True, told[1:] != told[:-1]])
            out.append((kx.squeeze(np.diff(np.append(first, told.size)).astype("<u4").tobytes()),
                        kx.squeeze(told[first].astype("<i8").tobytes())))
        return pa.table({"shard": rows.column("shard"), "bucket": rows.column("bucket"),
                         "lengths": pa.array([x[0] for x in out], pa.binary()),
                         "least": pa.array([x[1] for x in out], pa.binary())})

    return run


# ---- marking ---------------------------------------------------------------

def _mark(docs: Documents, shared: SharedPieces, told: list[dict] | None) -> np.ndarray:
    """Which bytes of the shard go."""
    covered = np.zeros(docs.text.size + 1, np.int32)
    if shared.uses.size:
        least = np.concatenate([np.repeat(np.frombuffer(kx.unsqueeze(t["least"]), "<i8"),
                                          np.frombuffer(kx.unsqueeze(t["lengths"]), "<u4")) for t in told or []])
        count = shared.sizes - docs.length + 1
        travelled = count[shared.order]
        start = np.empty(count.size, np.int64)
        start[shared.order] = np.cumsum(travelled) - travelled
        doc, first, n, piece = shared.uses.T
        known = least[expand(start[piece], n)] < np.repeat(docs.rank[doc], n)
        gone = expand(first, n)[known]
        np.add.at(covered, gone, 1)
        np.add.at(covered, gone + docs.length, -1)
    return np.cumsum(covered[:-1]) > 0


def _finish(length: int, buckets: int):
    def work(row: dict) -> Iterator[pa.RecordBatch]:
        docs = Documents(row, length)
        gone = _mark(docs, docs.shared(row["bits"], buckets), row["told"])
        out, start = [], 0
        for i, end in enumerate(docs.ends.tolist()):
            own, text = gone[start:end], docs.text[start:end]
            edge = np.flatnonzero(np.diff(np.r_[False, own, False].view(np.int8)))
            spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
            out.append((None if docs.null[i] else int(docs.ids[i]), end - start, int(own.sum()), len(spans),
                        hashlib.sha256(text[~own].tobytes()).hexdigest(), spans))
            start = end
        types = (pa.int64(),) * 4 + (pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return kx.per_shard(work)


def _offer(length: int, buckets: int):
    def work(row: dict) -> Iterator[pa.RecordBatch]:
        docs = Documents(row, length)
        yield kx.dealt(docs.number, *docs.keys(), buckets)

    return kx.per_shard(work)


def _deal(length: int, buckets: int):
    def work(row: dict) -> Iterator[pa.RecordBatch]:
        docs = Documents(row, length)
        yield docs.shared(row["bits"], buckets).rows(docs.number)

    return kx.per_shard(work)


def strip_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed ``spans`` (bytes, end exclusive) of every row."""
    if length < SEED:
        raise ValueError(f"length must be {SEED} at least")
    importable(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    shards = written(rows.mapInArrow(_pack, _DOCUMENTS), "repeat-shards")
    buckets = kx.bucket_count(docs)
    bits = written(kx.answers(shards.mapInArrow(_offer(length, buckets), kx.DEALT), (2, hot + 1)), "repeat-anchors")
    known = shards.join(bits, "shard", "left")
    pieces = known.mapInArrow(_deal(length, buckets), _PIECES)
    least = pieces.groupBy("bucket").applyInArrow(_resolve(length), _LEAST)
    told = least.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "lengths", "least"))).alias("told"))
    return known.join(told, "shard", "left").mapInArrow(_finish(length, buckets), _RESULT)


def repeats_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return strip_repeats(docs).drop("spans")


def oracle(length: int = LENGTH) -> str:
    """The same in DuckDB's SQL, every string of every text."""
    return f"""
with d as (select row_number() over () as row, doc_id, coalesce(doc_id, {_NULL}) as place,
    hex(encode(coalesce(text, ''))) as h from documents),
blocks as (select row, place, q, unnest(range(0, least(500, q_left))) as p, b from (
  select row, place, q, len(h) // 2 - {length - 1} - 500 * q as q_left, substr(h, 1000 * q + 1, {1000 + 2 * length - 2}) as b
  from (select row, place, h, unnest(range(0, (len(h) // 2 - {length - 1} + 499) // 500)) as q from d))),
s as (select row, place, 500 * q + p as p, substr(b, 2 * p + 1, {2 * length}) as s from blocks),
least as (select s, min(place) as least from s group by s),
hit as (select row, p from s join least using (s) where least < place),
edge as (select row, p, case when p > lag(p) over w + {length} or lag(p) over w is null then 1 else 0 end as new
  from hit window w as (partition by row order by p)),
span as (select row, min(p) as a, max(p) + {length} as b
  from (select row, p, sum(new) over (partition by row order by p) as g from edge) group by row, g),
kept as (select row, a, lag(b, 1, 0) over (partition by row order by a) as from_ from span),
last as (select row, max(b) as from_, sum(b - a)::bigint as n_removed, count(*) as n_spans from span group by row),
parts as (select row, a as part_at, substr(h, 2 * from_ + 1, 2 * (a - from_)) as part from kept join d using (row)
  union all select row, len(h), substr(h, 2 * coalesce(from_, 0) + 1) from d left join last using (row))
select any_value(doc_id) as doc_id, any_value(len(h) // 2)::bigint as n_bytes, any_value(coalesce(n_removed, 0))::bigint as n_removed,
  any_value(coalesce(n_spans, 0))::bigint as n_spans, sha256(unhex(string_agg(part, '' order by part_at))) as kept_sha256
from parts join d using (row) left join last using (row) group by row"""
