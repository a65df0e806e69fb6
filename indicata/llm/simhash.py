"""SimHash near-duplicates: 64-bit fingerprints joined by a binary trie self-join.

Fingerprints are made per Arrow batch: words, 4-word shingles, XXH64, one vote
per shingle and bit.  Equal fingerprints fold into one row first, so a group
of exact copies costs one trie leaf however large it is.

The self-join runs as Spark tasks over subtrees.  Two fingerprints at most
``max_bits`` apart agree exactly in one of ``max_bits + 1`` blocks of their
bits, so each fingerprint goes to one task group per block; a group is the
subtree below that block's value when the trie reads the block's bits first.
Inside, pairs of trie nodes are traversed together level by level, their
differing bits add up, and a pair beyond the budget is dropped with all that
lies below it.  A group of more than ``GROUP_ROWS`` fingerprints is dealt
anew by a block of its remaining bits (the same argument holds there), which
splits a hot subtree over many tasks.  A task returns spanning edges of the
links it found, never all pairs.

Components follow from the edges by alternating star joins with checkpoints.

Edge cases: a text that is null or has no word has fingerprint zero and links
like any other; rows with a null doc_id get a fingerprint and the component
of the ids that share or link to it (null if there is none); repeated rows
stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.llm.common import cut, fresh_name
from indicata.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
#: A task group above this many distinct fingerprints is dealt anew.
GROUP_ROWS = 20_000
#: Tasks over which the fingerprints of one component are dealt.
SALTS = 16
#: Node pairs that one traversal step holds.
FRONTIER = 1 << 18
_SHINGLE_CHUNK = 1 << 16
_HELD_ROWS = 1 << 19
#: Bits of each byte value, lowest first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of ``h`` have each bit set."""
    if h.size < 256:
        return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    columns = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8).T)
    per_byte = np.stack([np.bincount(c, minlength=256) for c in columns])
    return (per_byte @ _BYTE_BITS).reshape(-1)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of one text (unsigned)."""
    # in UTF-8 both the lower-casing and the six separators are single bytes
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not raw:
        return 0
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    line = b" ".join(raw)
    k = min(words, len(raw))
    starts = np.concatenate(([0], ends[:len(raw) - k])).tolist()
    ends = (ends[k - 1:] - 1).tolist()
    total, n = np.zeros(64, np.int64), len(starts)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _SHINGLE_CHUNK):
        h = np.array([digest(line[x:y], 42) for x, y in
                      zip(starts[i:i + _SHINGLE_CHUNK], ends[i:i + _SHINGLE_CHUNK])], np.uint64)
        total += _bit_sums(h)
    bits = np.packbits(total * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {id_type}, fp long")


# --- the trie self-join within one group ---------------------------------

def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    while True:
        up = parent[nodes]
        if (up == nodes).all():
            return nodes
        parent[nodes] = parent[up]
        nodes = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by smaller root, many pairs at a time."""
    while a.size:
        a, b = _roots(parent, a), _roots(parent, b)
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        low, high = low[open_], high[open_]
        np.minimum.at(parent, high, low)
        a, b = low, high


def trie_links(codes: np.ndarray, bits: int, max_bits: int = MAX_BITS,
               starts: np.ndarray | None = None) -> np.ndarray:
    """Position of the representative of each of ``codes`` among those linked to it.

    ``codes`` are unsigned, distinct and sorted within each group; ``starts``
    are the groups' first positions (default: one group).  Groups are tries
    of their own.

    The trie is implicit in the sorted order: a node of depth d is the run of
    codes that share their first d bits, held as (start, end).  The traversal
    starts with each group's pair (root, root); a pair of depth d has up to four pairs
    of children, of which the crossing ones add one differing bit.  Pairs over
    the budget go.  Steps of ``FRONTIER`` pairs are worked off depth first, so
    memory is bounded by depth x step whatever the number of links.
    """
    n = codes.size
    parent = np.arange(n)
    first = np.array([0] if n else [], np.int64) if starts is None else np.asarray(starts, np.int64)
    after = np.append(first[1:], n)[:first.size]
    some = after - first > 1
    first, after = first[some], after[some]
    stack = [(0, first, after, first, after, np.zeros(first.size, np.int8))]
    while stack:
        depth, a0, a1, b0, b1, d = stack.pop()
        if a0.size > FRONTIER:
            h = a0.size // 2
            stack.append((depth, a0[h:], a1[h:], b0[h:], b1[h:], d[h:]))
            stack.append((depth, a0[:h], a1[:h], b0[:h], b1[:h], d[:h]))
            continue
        # pairs of single codes are settled at once: a leaf path has no branches left
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = (i != j) & (np.bitwise_count(codes[i] ^ codes[j]) <= max_bits)
            _unite(parent, i[near], j[near])
            keep = ~single
            a0, a1, b0, b1, d = a0[keep], a1[keep], b0[keep], b1[keep], d[keep]
        if not a0.size or depth == bits:
            continue
        shift = np.uint64(bits - 1 - depth)
        am, bm = _split(codes, a0, a1, shift), _split(codes, b0, b1, shift)
        same = a0 == b0
        more = (d + 1).astype(np.int8)
        parts = ((a0, am, b0, bm, d, None), (am, a1, bm, b1, d, None),
                 (a0, am, bm, b1, more, None), (am, a1, b0, bm, more, ~same))
        out = []
        for p0, p1, q0, q1, e, only in parts:
            ok = (p1 > p0) & (q1 > q0) & (e <= max_bits)
            if only is not None:  # of a node with itself the crossing pair counts once
                ok &= only
            ok &= ~((p1 - p0 == 1) & (p0 == q0) & (p1 == q1))
            out.append((p0[ok], p1[ok], q0[ok], q1[ok], e[ok]))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*out))))
    return _roots(parent, np.arange(n))


def _split(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.uint64) -> np.ndarray:
    """First position of each run whose bit at ``shift`` is one (binary search in the run)."""
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(1)
    while True:
        todo = np.flatnonzero(lo < hi)
        if not todo.size:
            return lo
        l, h = lo[todo], hi[todo]
        mid = (l + h) >> 1
        bit = (codes[mid] >> shift) & one == one
        hi[todo] = np.where(bit, mid, h)
        lo[todo] = np.where(bit, l, mid + 1)


def _edges(max_bits: int):
    """(chain, top, code, fp) rows in that order -> (a, b) spanning edges."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        chain, top, code, fp = (rows.column(c).to_numpy() for c in range(4))
        new = np.ones(chain.size, bool)
        new[1:] = (chain[1:] != chain[:-1]) | (top[1:] != top[:-1])
        starts = np.flatnonzero(new)
        root = trie_links(code.view(np.uint64), 64, max_bits, starts)
        linked = np.flatnonzero(root != np.arange(root.size))
        return pa.RecordBatch.from_arrays([pa.array(fp[root[linked]]), pa.array(fp[linked])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < _HELD_ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            chain, top = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            other = np.flatnonzero((chain != chain[-1]) | (top != top[-1]))
            done = int(other[-1]) + 1 if other.size else 0  # the last group may go on
            if done:
                yield solve(rows.slice(0, done))
            held = rows.slice(done).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _deal(rows: DataFrame, max_bits: int) -> DataFrame:
    """Each row once per block of its free bits, that block moved to the top of them.

    ``code`` is the fingerprint with its bits reordered: the ``fixed`` topmost
    are what a group shares.  ``chain`` names the blocks chosen so far, three
    bits a level, and ``top`` is the shared part, so (chain, top) is a group.
    """
    n = max_bits + 1
    out = rows.withColumn("block", F.explode(F.array(*[F.lit(i) for i in range(n)])))
    out = out.withColumn("free", F.expr("64 - fixed"))
    out = out.withColumn("low", F.expr("if(free = 64, -1L, shiftleft(1L, free) - 1)"))
    # the block's bits, counted from the top of the free ones, come first after a rotation by ``by``
    out = out.withColumn("by", F.expr(f"cast(floor(free * block / {n}) as int)"))
    out = out.withColumn("width", F.expr(f"cast(floor(free * (block + 1) / {n}) as int) - by"))
    turned = ("if(by = 0, code & low, (shiftleft(code & low, by) & low) | "
              "shiftrightunsigned(code & low, free - by))")
    out = out.withColumn("code", F.expr(f"(code & ~low) | ({turned})"))
    return out.select("fp", F.expr("chain * 8 + block + 1").alias("chain"),
                      F.expr("shiftrightunsigned(code, 64 - (fixed + width))").alias("top"),
                      "code", F.expr("fixed + width").alias("fixed"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Spanning edges (a, b) of all links between the distinct fingerprints ``fps.fp``."""
    if not 0 <= max_bits <= 6:
        raise ValueError("max_bits must be 0 to 6")
    spark = fps.sparkSession
    found = []
    todo = fps.select("fp", F.lit(0).cast("long").alias("chain"), F.col("fp").alias("code"),
                      F.lit(0).alias("fixed"))
    while True:
        dealt = _deal(todo, max_bits)
        sizes = dealt.groupBy("chain", "top").agg(F.count("*").alias("n"), F.max("fixed").alias("f"))
        large = cut(sizes.where((F.col("n") > group_rows) & (F.col("f") < 64 - max_bits)).select("chain", "top"))
        last = large.isEmpty()
        small = dealt if last else dealt.join(large, ["chain", "top"], "left_anti")
        found.append(small.select("chain", "top", "code", "fp").repartition("chain", "top")
                     .sortWithinPartitions("chain", "top", "code")
                     .mapInArrow(_edges(max_bits), "a long, b long"))
        if last:
            break
        todo = cut(dealt.join(large, ["chain", "top"], "left_semi").select("fp", "chain", "code", "fixed"))
    out = functools.reduce(DataFrame.union, found)
    return out if found else spark.createDataFrame([], "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id reachable."""
    rows = cut(fingerprints(docs, id_col, text, words))
    # exact copies fold before the join: one row per fingerprint, combined on the map side
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("fp"), max_bits))
    placed = cut(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "root"))
    alone = placed.where(F.col("root").isNull()).select("fp", F.col("least").alias("component_id"))
    # of linked fingerprints a component may have a great part: each root is dealt over SALTS tasks
    linked = placed.where(F.col("root").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    of_fp = alone.union(linked.join(least, ["root", "salt"]).select("fp", "component_id"))
    return rows.join(of_fp, "fp").select("id", "fp", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id.

    A null doc_id comes after all others.  Where the smallest doc_id of a group
    is repeated, one of its texts stays (that of the smallest hash, so the
    choice is stable), once.  Rows of one doc_id whose texts are not near each
    other are in groups of their own and all stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                   F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b"))
    name = fresh_name(docs.columns, "key")
    keyed = docs.withColumn(name, key)
    groups = near_duplicates(keyed.select(name, "text"), name, words=words, max_bits=max_bits)
    kept = groups.where(F.col("id") == F.col("component_id")).select(F.col("id").alias(name)).distinct()
    # the semi join deals the rows by key, which the de-duplication of repeated rows reuses
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
