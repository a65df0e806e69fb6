"""Ranked lexical search over per-term blocks of similar documents.

``search`` ranks all documents for each item of a query table by a sum of
integer term scores and returns each item's best ``k``, exactly.

How it runs.  The query table is taken in blocks of bounded size.  For each,
one pass over the documents keeps every document's length and its counts of
the block's terms; corpus counts (documents, terms, documents per term) are
sums over all of them.  A second narrow pass indexes the documents of each
task, some thousand at a time: the posting list of every term is clustered by
document similarity into blocks of about ``BLOCK`` documents, and every block
keeps the coordinatewise maximum of its documents' term scores.  An item
visits the blocks of its terms in the order of their bounds (the item's dot
product with the block's maxima); a block is skipped only if its bound is below
the item's k-th best score so far, so no result is lost.  The same holds for
whole lists, whose summary is the list's maximum: as long as the maxima of an
item's weakest terms add up to less than that score, no document that is in
those lists alone can count, so the lists that no item needs are not built.
Each task returns at most ``k`` documents an item, which one small window
merges.

Terms are the maximal matches of ``TERM``, with A-Z lower-cased and nothing
else.  With N documents that hold a term, L terms in them, n in one document:
weight w = floor(1000 ln((2N+2)/(2df+1))), m = 25 + (75 n N) div L, and the
score sums w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats
included.

Edge cases: a null or empty text has no term, is no result and adds nothing
to N, L and df; an item without terms, or with terms that no document holds,
has no row; an empty table gives no row.  Every row is a document or an item of its own, also where
ids repeat or are null; a null doc_id comes after all others among equal
scores.  Columns besides the named ones play no part, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indicata.llm import words
from indicata.llm.common import importable, slices, written
from indicata.llm.words import expand

# The term pattern, the parts of the score.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
RANGE_75, SCALE, TF_1000, M_8 = 75, 1_000_000_000, 1000, 8

TOP_K = 10
#: Documents in a block of similar documents, about.
BLOCK = 32
#: (block, term) entries that one index makes at a time; bounds its memory.
INDEX_ENTRIES = 3 << 20
#: Documents that each task scores without an index, for first thresholds.
SEEDS = 256
#: Characters of item texts in one block of the query table.
ITEM_CHARS = 4 << 20
#: Dimensions in which similarity is judged for the clustering.
SKETCH = 16

_TERM = re.compile(TERM)
#: The same for whole buffers: what is no part of a term becomes a blank.
_TERM_BYTES = words.table(bytes(b for b in range(128) if not chr(b).isalnum()), b" ")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text: str | None) -> list[str]:
    return _TERM.findall(text.translate(_LOWER)) if text else []


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """(item id, text) rows of the query table, ``ITEM_CHARS`` characters at a time."""
    held, chars = [], 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        size = len(row["t"] or "")
        if held and chars + size > ITEM_CHARS:
            yield held
            held, chars = [], 0
        held.append((row["i"], row["t"]))
        chars += size
    if held:
        yield held


def _vectors(query):
    """(doc id, text) -> doc id, number of terms, the wanted terms and their counts."""

    def work(ids: pa.Array, texts: pa.Array, known: pa.Array) -> pa.RecordBatch:
        row, found = words.split(words.mapped(texts, _TERM_BYTES), " ")
        code = pc.index_in(found, value_set=known)
        wanted = code.is_valid().to_numpy(zero_copy_only=False)
        key, count = np.unique(row[wanted] * max(len(known), 1) + code.drop_null().to_numpy(), return_counts=True)
        held = np.bincount(key // max(len(known), 1), minlength=len(ids))
        offsets = pa.array(np.append(0, np.cumsum(held)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.bincount(row, minlength=len(ids))),
             pa.ListArray.from_arrays(offsets, pa.array((key % max(len(known), 1)).astype(np.int32))),
             pa.ListArray.from_arrays(offsets, pa.array(count))], names=["id", "n", "terms", "counts"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(query.value, pa.string())
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for s, e in slices(lengths):
                yield work(batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), known)

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(counts: np.ndarray, lengths: np.ndarray, weights: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Score of each (term, document) entry, in 64-bit integers."""
    m = (100 - RANGE_75) + (RANGE_75 * lengths * documents) // total
    return weights * ((SCALE * counts) // (TF_1000 * counts + M_8 * m))


class BlockIndex:
    """Posting lists of some documents, cut into blocks of similar ones with their maxima.

    Lists are made for the terms marked in ``needed`` (default: all).
    """

    def __init__(self, offsets: np.ndarray, term: np.ndarray, impact: np.ndarray, width: int,
                 needed: np.ndarray | None = None, block: int = BLOCK):
        self.offsets, self.term, self.impact, self.width = offsets, term, impact, width
        size = np.diff(offsets)
        doc = np.repeat(np.arange(size.size), size)
        look = self._sketches(doc, size.size)
        listed = np.arange(term.size) if needed is None else np.flatnonzero(needed[term])
        listed = listed[np.argsort(term[listed], kind="stable")]
        of_term = doc[listed]
        at = np.searchsorted(term[listed], np.arange(width + 1))
        docs, starts, lists = [], [], np.zeros(width + 1, np.int64)
        held = blocks = 0
        for t in range(width):
            own = of_term[at[t]:at[t + 1]]
            if own.size:
                own, cuts = self._cluster(own, look, block)
                docs.append(own)
                starts.append(cuts + held)
                held += own.size
                blocks += cuts.size
            lists[t + 1] = blocks
        #: blocks of term t are lists[t] to lists[t + 1]; block b holds docs[starts[b]:starts[b + 1]]
        self.lists, self.docs = lists, np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.starts = np.append(np.concatenate(starts) if starts else np.zeros(0, np.int64), held)
        self._summarise(size, blocks)

    def _sketches(self, doc: np.ndarray, n: int) -> np.ndarray:
        """Documents as short vectors: terms fall on dimensions with a sign, both by a mixed term number."""
        mixed = (self.term.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        spot = (mixed >> np.uint64(40)).astype(np.int64) % SKETCH
        sign = np.where((mixed >> np.uint64(33)) & np.uint64(1), 1.0, -1.0)
        out = np.bincount(doc * SKETCH + spot, sign * self.impact, n * SKETCH).reshape(n, SKETCH)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def _cluster(docs: np.ndarray, look: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """``docs`` with similar ones side by side, and where blocks begin (2 x ``block`` documents at most)."""
        if docs.size <= block:
            return docs, np.zeros(1, np.int64)
        near = np.argmax(look[docs] @ look[docs[::block]].T, axis=1)
        order = np.argsort(near, kind="stable")
        docs, near = docs[order], near[order]
        first = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
        within = np.arange(docs.size) - np.repeat(first, np.diff(np.append(first, docs.size)))
        return docs, np.flatnonzero(within % (2 * block) == 0)

    def _summarise(self, size: np.ndarray, blocks: int) -> None:
        """Coordinatewise maximum over each block's documents, ordered by term and block."""
        width = max(blocks, 1)
        of_block = np.repeat(np.arange(blocks), np.diff(self.starts))
        at = expand(self.offsets[self.docs], size[self.docs])
        key = self.term[at] * np.int64(width) + np.repeat(of_block, size[self.docs])
        value = self.impact[at]
        low = int(value.max(initial=0)).bit_length()
        if int(key.max(initial=0)).bit_length() + low < 64:  # one word for both sorts faster
            key = np.sort((key << low) | value)
            key, value = key >> low, key & ((1 << low) - 1)
        else:
            order = np.lexsort((value, key))
            key, value = key[order], value[order]
        last = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) if key.size else np.zeros(0, np.int64)
        self.most, self.in_block = value[last], key[last] % width
        self.of_term = np.searchsorted(key[last] // width, np.arange(self.width + 1))

    def bounds(self, wanted: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Most that any document of each block can score for an item."""
        out = np.zeros(self.starts.size - 1, np.int64)
        for t, c in zip(wanted, times):
            s, e = self.of_term[t], self.of_term[t + 1]
            out[self.in_block[s:e]] += c * self.most[s:e]
        return out

    def scores(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        size = np.diff(self.offsets)[docs]
        at = expand(self.offsets[docs], size)
        return np.add.reduceat(self.impact[at] * query[self.term[at]], np.cumsum(size) - size)

    def search(self, wanted: np.ndarray, times: np.ndarray, lists: np.ndarray, query: np.ndarray, best: Best,
               ids: np.ndarray, null: np.ndarray) -> None:
        """Adds to ``best`` what these documents have for an item; ``lists`` are the terms whose lists it needs."""
        bound = self.bounds(wanted, times)
        mine = expand(self.lists[lists], self.lists[lists + 1] - self.lists[lists])
        mine = mine[bound[mine] >= max(best.least(), 1)]
        mine = mine[np.argsort(-bound[mine], kind="stable")]
        seen = np.zeros(self.offsets.size - 1, bool)
        at, step = 0, 4
        while at < mine.size and bound[mine[at]] >= best.least():
            part = mine[at:at + step]
            part = part[bound[part] >= best.least()]
            docs = self.docs[expand(self.starts[part], self.starts[part + 1] - self.starts[part])]
            docs = np.unique(docs[~seen[docs]])
            if docs.size:
                seen[docs] = True
                best.add(self.scores(docs, query), ids[docs], null[docs])
            at, step = at + step, step * 2


class Best:
    """The k best (score, id) seen: highest score, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score = k, np.zeros(0, np.int64)
        self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        return int(self.score[-1]) if self.score.size == self.k else 0

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = (score > 0) & (score >= self.least())
        score = np.concatenate([self.score, score[good]])
        ids, null = np.concatenate([self.ids, ids[good]]), np.concatenate([self.null, null[good]])
        order = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


def essential(wanted: np.ndarray, times: np.ndarray, most: np.ndarray, least: int) -> np.ndarray:
    """Terms of an item without whose lists a document could still reach ``least``.

    ``most`` is the highest score of each term in any document; the weakest
    terms are left out as long as all of them together stay below ``least``.
    """
    score = times * most[wanted]
    order = np.argsort(score, kind="stable")
    kept = order[(np.cumsum(score[order]) >= max(least, 1))]
    return wanted[kept]


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose index makes at most ``INDEX_ENTRIES`` entries, one document at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n * n > INDEX_ENTRIES:
            yield start, i
            start, held = i, 0
        held += n * n
    if start < sizes.size:
        yield start, sizes.size


def _rank(query, k: int):
    """Document vectors -> each item's ``k`` best of the task: item number, doc id, score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, documents, total, wanted, times = query.value
        best = [Best(k) for _ in wanted]
        vector = np.zeros(weights.size, np.int64)

        def take(rows: pa.Table) -> None:
            rows = rows.combine_chunks()
            lists, counts = (rows.column(c).combine_chunks() for c in ("terms", "counts"))
            sizes = lists.value_lengths().to_numpy()
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
            term = lists.flatten().to_numpy().astype(np.int64)
            n = np.repeat(rows.column("n").to_numpy(), sizes)
            score = impacts(counts.flatten().to_numpy(), n, weights[term], documents, total)
            ids = rows.column("id").combine_chunks()
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for s, e in _runs(sizes):
                lo, hi = offsets[s], offsets[e]
                rank(offsets[s:e + 1] - lo, term[lo:hi], score[lo:hi], ids[s:e], null[s:e])

        def rank(offsets: np.ndarray, term: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
            nonlocal seeded
            direct = ids.size if ids.size == 1 else min(ids.size, max(0, SEEDS - seeded))
            if direct:  # blocks of one document: the bound is the score
                end = offsets[direct]
                for i, item in enumerate(wanted):
                    vector[item] = times[i]
                    best[i].add(np.add.reduceat(score[:end] * vector[term[:end]], offsets[:direct]), ids[:direct], null[:direct])
                    vector[item] = 0
                seeded += direct
                offsets, term, score = offsets[direct:] - end, term[end:], score[end:]
                ids, null = ids[direct:], null[direct:]
            if not ids.size:
                return
            most = np.zeros(weights.size, np.int64)
            np.maximum.at(most, term, score)
            lists = [essential(item, times[i], most, best[i].least()) for i, item in enumerate(wanted)]
            needed = np.zeros(weights.size, bool)
            needed[np.concatenate(lists)] = True
            index = BlockIndex(offsets, term, score, weights.size, needed)
            for i, item in enumerate(wanted):
                vector[item] = times[i]
                index.search(item, times[i], lists[i], vector, best[i], ids, null)
                vector[item] = 0

        seeded = 0
        held: list[pa.RecordBatch] = []
        cost = 0
        for batch in batches:
            some = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            for at in range(0, some.num_rows, 256):
                part = some.slice(at, 256)
                held.append(part)
                cost += int((part.column("terms").value_lengths().to_numpy().astype(np.int64) ** 2).sum())
                if cost >= INDEX_ENTRIES:
                    take(pa.Table.from_batches(held))
                    held, cost = [], 0
        if held:
            take(pa.Table.from_batches(held))
        for i, b in enumerate(best):
            if b.score.size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b.score.size, i, np.int32)), pa.array(b.ids, mask=b.null), pa.array(b.score)],
                    names=["item", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, block: list[tuple], k: int, item_type) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    found = [Counter(terms(t)) for _, t in block]
    index = {t: i for i, t in enumerate(sorted(set().union(*found)))}
    vectors = written(docs.mapInArrow(_vectors(sc.broadcast(list(index))), "id long, n long, terms array<int>, counts array<long>"),
                      "search-vectors")
    documents, total = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(index), np.int64)
    # one number for each term of the block, which is bounded
    for t, df in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[t] = weight(documents, df)
    wanted = [np.array([index[t] for t in c], np.int64) for c in found]
    times = [np.array(list(c.values()), np.int64) for c in found]
    query = sc.broadcast((weights, documents, max(total, 1), wanted, times))
    near = vectors.mapInArrow(_rank(query, k), "item int, doc_id long, score long")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item int, item_id {item_type}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every item."""
    importable(docs.sparkSession)
    kind = items.schema[item_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    parts = [_search_block(rows, b, k, kind) for b in _item_blocks(items, item_id, item_text)]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return functools.reduce(DataFrame.union, parts)


def oracle() -> str:
    """The same ranking in DuckDB's SQL, every document scored for every item."""
    words = (f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             f"'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))")
    return f"""
with d as (select row_number() over () as row, doc_id, text from documents),
words as (select row, doc_id, {words} as term from d),
tf as (select row, any_value(doc_id) as doc_id, term, count(*) as tf from words group by row, term),
len as (select row, sum(tf)::bigint as n from tf group by row),
corpus as (select count(*) as docs, sum(n)::bigint as total from len),
df as (select term, count(*) as df from tf group by term),
b as (select row_number() over () as item, item_id, text from benchmark),
wanted as (select item, any_value(item_id) as item_id, term, count(*) as times
           from (select item, item_id, {words} as term from b) group by item, term),
scored as (
  select item, any_value(item_id) as item_id, tf.row, any_value(doc_id) as doc_id,
    sum(times * (floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint
      * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))))::bigint as score
  from wanted join df using (term) join tf using (term) join len using (row) cross join corpus
  group by item, tf.row),
ranked as (select *, row_number() over (partition by item order by score desc, doc_id) as rank
           from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= {TOP_K}"""
