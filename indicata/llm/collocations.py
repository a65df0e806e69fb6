"""Phrase collocations by prefix-free parsing.

``collocations`` finds, per language, the word sequences of 2 to 5 words that
occur at least ``MIN_COUNT`` times and ranks them by how much more often they
occur than their parts do together.

How it runs.
1. Parsing.  Pieces are cut into chunks where a word's own hash says so, so
   equal stretches of text are cut alike wherever they stand.  A chunk owns
   the words up to the next cut and carries the four after it: every sequence
   of up to five words lies whole in the chunk that owns its first word, and
   is counted there alone.  One aggregate makes the dictionary of distinct
   chunks with their parse frequencies.
2. The dictionary is written as shards of about ``SHARD_WORDS`` words, as
   numbers into a vocabulary of the shard's own.
3. Sequences are counted inside the distinct chunks, weighted by frequency:
   words first, then pairs of frequent words, then longer ones all of whose
   pairs are frequent.  Each round goes through ``key_exchange``: shards name
   hashes with weights and get back one bit for each.  The bits only
   rule out; what is left is counted exactly, by the phrase itself: a shard
   sends each bucket its phrases as one row, and the bucket adds them up.
4. Cuts, containment and rank are joins and windows over frequent phrases.

A whole corpus never meets in one task: a hot chunk, word or pair is one
row or entry of each shard that has it, and the rank of a language is taken in
two steps.

Edge cases: a null text is empty and adds nothing; a null language is ``und``
and joins rows that are called so; an empty table gives no row.  Rows are
counted each, whatever their ids.  A piece without a cut is one chunk, so a
very long piece without one is held whole.  ``n``, ``a``, ``l`` and ``r`` are
longs; the score is computed in 38 digits.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indicata.llm import key_exchange as kx
from indicata.llm import words
from indicata.llm.common import importable, slices, written

# What ends a piece and what separates words.
PIECE_END, BLANK = b".,;:!?\n\v\f\r", b" \t"

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
FACTOR = 1000
#: A candidate goes if a longer one has this share of its count, in percent.
SHARE = 100
UNKNOWN = "und"
#: One word in so many begins a chunk.
PERIOD = 16
SHARD_WORDS = 1 << 20
#: Phrases named in one batch.
_BATCH = 1 << 17
#: Salts of the first ranking step.
_SALTS = 64

#: Buffers as wanted: what ends a piece is a line feed, what separates words a blank.
_BYTES = words.table(PIECE_END, b"\n", words.table(BLANK, b" "))
_SHARDS = "shard long, langs string, words binary, word_lang binary, hashes binary, tokens binary, size binary, own binary, times binary"
_NAMED = "bucket int, langs string, lang binary, size binary, a binary, phrase binary"
#: Sequence lengths that each round counts.
ROUNDS = ((1,), (2,), tuple(range(3, LONGEST + 1)))


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number, number of owned words, chunk) of the parse of ``texts``."""
    text, pieces = words.split(words.mapped(texts, _BYTES), "\n")
    piece, found = words.split(pieces, " ")
    coded = found.dictionary_encode()
    triggers = np.fromiter((crc32(w.encode()) % PERIOD == 0 for w in coded.dictionary.to_pylist()), bool, len(coded.dictionary))
    new = np.append(True, piece[1:] != piece[:-1])[:piece.size]
    begin = np.flatnonzero(new | triggers[coded.indices.to_numpy()]) if piece.size else np.zeros(0, np.int64)
    own = np.diff(np.append(begin, piece.size))
    ends = np.append(np.flatnonzero(new)[1:], piece.size)  # of the pieces that have words
    size = np.minimum(own + LONGEST - 1, ends[np.cumsum(new)[begin] - 1] - begin)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)),
                                     found.take(pa.array(words.expand(begin, size))))
    return text[piece[begin]], own, pc.binary_join(lists, " ")


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, own, chunk, times), folded slice by slice."""
    for batch in batches:
        langs = pc.fill_null(batch.column(0).cast(pa.string()), UNKNOWN)
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        for s, e in slices(lengths):
            text, own, chunk = chunks(batch.column(1).slice(s, e - s))
            rows = pa.table({"lang": langs.slice(s, e - s).take(pa.array(text)), "own": pa.array(own.astype(np.int32)), "chunk": chunk})
            folded = rows.group_by(["lang", "own", "chunk"]).aggregate([([], "count_all")])
            yield from folded.rename_columns(["lang", "own", "chunk", "times"]).combine_chunks().to_batches()


def parse(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The dictionary: lang, own, chunk and how often the parse has it."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    parsed = rows.mapInArrow(_parse, "lang string, own int, chunk string, times long")
    return parsed.groupBy("lang", "own", "chunk").agg(F.sum("times").alias("times"))


def _shard(number: int, rows: pa.Table) -> pa.RecordBatch:
    """Dictionary rows as numbers into a vocabulary of (language, word) pairs."""
    lists = pc.split_pattern(rows.column("chunk").combine_chunks(), " ")
    size = lists.value_lengths().to_numpy().astype(np.int64)
    words_, langs = lists.flatten().dictionary_encode(), rows.column("lang").combine_chunks().dictionary_encode()
    width = len(words_.dictionary)
    pair, tokens = np.unique(np.repeat(langs.indices.to_numpy().astype(np.int64), size) * width + words_.indices.to_numpy(),
                             return_inverse=True)
    names, vocabulary = langs.dictionary.to_pylist(), words_.dictionary.take(pa.array(pair % width)).to_pylist()
    word_lang = pair // width
    prefix = [n.encode() + b" " for n in names]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(prefix[g] + w.encode()) for g, w in zip(word_lang.tolist(), vocabulary)),
                         np.uint64, len(vocabulary))
    low = [kx.squeeze(np.ascontiguousarray(x, t).tobytes()) for x, t in
           ((word_lang, "<u4"), (hashes, "<u8"), (tokens, "<u4"), (size, "<u4"), (rows.column("own").to_numpy(), "<u4"),
            (rows.column("times").to_numpy(), "<i8"))]
    columns = [number, json.dumps(names), kx.squeeze("\n".join(vocabulary).encode()), *low]
    return pa.RecordBatch.from_arrays(
        [pa.array([x], t) for x, t in zip(columns, (pa.int64(), pa.string(), *[pa.binary()] * 7))],
        names=["shard", "langs", "words", "word_lang", "hashes", "tokens", "size", "own", "times"])


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary rows -> shards of ``SHARD_WORDS`` words, about."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        blanks = pc.count_substring(batch.column(batch.schema.get_field_index("chunk")), " ").to_numpy().astype(np.int64) + 1
        cuts = np.searchsorted(np.cumsum(blanks), np.arange(SHARD_WORDS - size, int(blanks.sum()) + 1, SHARD_WORDS)) + 1
        at = 0
        for cut in [*np.unique(cuts).tolist(), batch.num_rows]:
            if cut > at:
                held.append(batch.slice(at, cut - at))
                size += int(blanks[at:cut].sum())
                at = cut
            if size >= SHARD_WORDS:
                yield _shard(number, pa.Table.from_batches(held))
                held, size, number = [], 0, number + 1
    if held:
        yield _shard(number, pa.Table.from_batches(held))


class Shard:
    """Token numbers of a shard's chunks, with what is left of the chunk and its weight at each place."""

    def __init__(self, row: dict):
        self.number, self.langs = row["shard"], json.loads(row["langs"])
        read = lambda c, t: np.frombuffer(kx.unsqueeze(row[c]), t)
        self.words = kx.unsqueeze(row["words"]).decode().split("\n")
        self.word_lang, self.hashed, self.tokens = read("word_lang", "<u4"), read("hashes", "<u8"), read("tokens", "<u4")
        size, own, times = read("size", "<u4").astype(np.int64), read("own", "<u4").astype(np.int64), read("times", "<i8")
        end = np.cumsum(size)
        place = np.arange(self.tokens.size) - np.repeat(end - size, size)
        #: words from a place to its chunk's end; how often the parse has the place, 0 where the next chunk owns it
        self.left = np.repeat(size, size) - place
        self.times = np.where(place < np.repeat(own, size), np.repeat(times, size), 0)
        #: where a frequent sequence of n words begins, as far as the rounds have told
        self.frequent: dict[int, np.ndarray] = {}

    def hashes(self, n: int) -> np.ndarray:
        """A hash of the n words from each place on (what follows the last is not to be used)."""
        one = h = self.hashed[self.tokens]
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h[:one.size - k] += one[k:]
        return self._mixed(h, n)

    @staticmethod
    def _mixed(h: np.ndarray, n: int) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        return h ^ (h >> np.uint64(32))

    def candidates(self, n: int) -> np.ndarray:
        """Places where n words begin whose parts of the last known length are all frequent."""
        ok = self.left >= n
        if self.frequent:
            k = max(x for x in self.frequent if x < n)
            for i in range(n - k + 1):
                ok[:ok.size - i] &= self.frequent[k][i:]
        return np.flatnonzero(ok)

    def keys(self, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """Sorted distinct hashes of all candidates of these lengths, their weights, and (length, places)."""
        if lengths == (1,):  # the vocabulary has them already
            weight = np.bincount(self.tokens, self.times.astype(float), self.hashed.size).astype(np.uint64)
            keys, where = np.unique(self._mixed(self.hashed, 1) & kx.KEY_MASK, return_inverse=True)
            return keys, np.bincount(where, weight.astype(float), keys.size).astype(np.uint64), [(1, where[self.tokens])]
        places = [(n, self.candidates(n)) for n in lengths]
        h = np.concatenate([self.hashes(n)[at] & kx.KEY_MASK for n, at in places])
        weight = np.concatenate([self.times[at] for _, at in places])
        keys, where = np.unique(h, return_inverse=True)
        return keys, np.bincount(where, weight.astype(float), keys.size).astype(np.uint64), \
            [(n, w) for (n, _), w in zip(places, np.split(where, np.cumsum([at.size for _, at in places])[:-1]))]

    def learn(self, lengths: tuple[int, ...], bits: list[dict] | None) -> None:
        """Takes in what a round has told about ``keys(lengths)``."""
        found, = kx.marks(bits, 1)
        places = [self.candidates(n) for n in lengths]
        for (n, where), at in zip(self.keys(lengths)[2], places):
            self.frequent[n] = np.zeros(self.tokens.size, bool)
            self.frequent[n][at[found[where]]] = True

    def phrases(self) -> Iterator[tuple[int, int, int]]:
        """(n, place, count) of each distinct frequent sequence that the shard owns."""
        for n in sorted(self.frequent):
            at = np.flatnonzero(self.frequent[n] & (self.times > 0))
            if not at.size:
                continue
            _, first, where = np.unique(self.hashes(n)[at], return_index=True, return_inverse=True)
            same = np.array([self.tokens[at + i] == self.tokens[at[first[where]] + i] for i in range(n)]).all()
            if not same:  # two sequences share a hash: told apart by their words
                rows = np.stack([self.tokens[at + i] for i in range(n)], 1)
                _, first, where = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            count = np.zeros(first.size, np.int64)
            np.add.at(count, where.ravel(), self.times[at])
            yield from ((n, p, c) for p, c in zip(at[first].tolist(), count.tolist()))


def _told(row: dict, rounds: int) -> Shard:
    shard = Shard(row)
    for i in range(rounds):
        shard.learn(ROUNDS[i], row[f"bits{i}"])
    return shard


def _count(rounds: int, buckets: int):
    def work(row: dict) -> Iterator[pa.RecordBatch]:
        shard = _told(row, rounds)
        keys, weights, _ = shard.keys(ROUNDS[rounds])
        yield kx.dealt(shard.number, keys, weights, buckets)

    return kx.per_shard(work)


def _name(buckets: int):
    """Shards with all bits -> a row for each bucket with the (lang, n, phrase, a) of what may be frequent."""

    def work(row: dict) -> Iterator[pa.RecordBatch]:
        shard = _told(row, len(ROUNDS))
        deal = {n: (shard.hashes(n) % np.uint64(buckets)).astype(np.int32) for n in shard.frequent}
        tokens, langs = shard.tokens, shard.langs
        held: list[tuple] = []
        for n, at, count in shard.phrases():
            ids = tokens[at:at + n].tolist()
            held.append((int(deal[n][at]), int(shard.word_lang[ids[0]]), n, " ".join([shard.words[i] for i in ids]), count))
            if len(held) >= _BATCH:
                yield _named(held, langs)
                held = []
        if held:
            yield _named(held, langs)

    return kx.per_shard(work)


def _named(rows: list[tuple], langs: list[str]) -> pa.RecordBatch:
    """Phrases of a shard, those of a bucket as one row."""
    rows.sort(key=lambda r: r[0])
    bucket, lang, size, phrase, count = zip(*rows)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(rows)]))
    packed = [[kx.squeeze(np.array(column[s:e], t).tobytes()) for s, e in cuts]
              for column, t in ((lang, "<u4"), (size, "u1"), (count, "<i8"))]
    texts = [kx.squeeze("\n".join(phrase[s:e]).encode()) for s, e in cuts]
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket[s] for s, _ in cuts], pa.int32()), pa.array([json.dumps(langs)] * len(cuts)),
         *[pa.array(x, pa.binary()) for x in (*packed, texts)]],
        names=["bucket", "langs", "lang", "size", "a", "phrase"])


def _sum_named(min_count: int):
    def run(rows: pa.Table) -> pa.Table:
        parts = []
        for row in rows.to_pylist():
            read = lambda c, t: np.frombuffer(kx.unsqueeze(row[c]), t)
            parts.append(pa.table({
                "lang": pa.array(json.loads(row["langs"]), pa.string()).take(pa.array(read("lang", "<u4"))),
                "size": pa.array(read("size", "u1").astype(np.int32)),
                "phrase": pa.array(kx.unsqueeze(row["phrase"]).decode().split("\n"), pa.string()),
                "a": pa.array(read("a", "<i8"))}))
        found = pa.concat_tables(parts).group_by(["lang", "size", "phrase"]).aggregate([("a", "sum")]).rename_columns(
            ["lang", "size", "phrase", "a"])
        return found.filter(pc.greater_equal(found.column("a"), min_count))

    return run


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, lang: str = "lang",
                     text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, a) of 1 to 5 words with a >= ``min_count``, (lang, n) with the words of each language)."""
    importable(docs.sparkSession)
    dictionary = written(parse(docs, lang, text), "phrase-chunks")
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    shards = written(dictionary.mapInArrow(_shards, _SHARDS), "phrase-shards")
    buckets = kx.bucket_count(docs)
    known = shards
    for i in range(len(ROUNDS)):
        told = kx.answers(known.mapInArrow(_count(i, buckets), kx.DEALT), (min_count,))
        told = written(told.withColumnRenamed("bits", f"bits{i}"), f"phrase-bits{i}")
        known = known.join(told, "shard", "left")
    named = known.mapInArrow(_name(buckets), _NAMED)
    counts = named.groupBy("bucket").applyInArrow(_sum_named(min_count), "lang string, size int, phrase string, a long")
    return written(counts, "phrase-counts"), totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, lang: str = "lang",
                 text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    counts, totals = frequent_phrases(docs, min_count, lang, text)
    found = counts.where("size > 1").select("lang", "phrase", "a", F.split("phrase", " ").alias("w"))
    part = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("times"))
    # a candidate's parts occur at least as often as it does, so they are all in ``counts``
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"),
                       F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("tail"))
    cuts = cuts.join(part.withColumnsRenamed({"part": "head", "times": "l"}), ["lang", "head"])
    cuts = cuts.join(part.withColumnsRenamed({"part": "tail", "times": "r"}), ["lang", "tail"]).join(totals, "lang")
    whole = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r", "n")}
    score = F.expr(f"cast({FACTOR} as decimal(4,0)) * a_ * n_ div (l_ * r_)")
    scored = cuts.withColumns({f"{c}_": x for c, x in whole.items()}).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r", "n")).alias("cut")).select(
            "lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")
    spans = "flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), " \
            "s -> array_join(slice(w, s, m), ' '))))"
    inside = found.where("size(w) > 2").select("lang", "a", F.explode(F.expr(spans)).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * SHARE)).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))
    first = Window.partitionBy("lang", "salt").orderBy(*order)
    near = kept.withColumn("salt", salt).withColumn("place", F.row_number().over(first)).where(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(min_count: int = MIN_COUNT, top: int = TOP) -> str:
    """The same in DuckDB's SQL, every occurrence counted."""
    grams = " union all ".join(
        f"select lang, {k} as size, array_to_string(w[i:i + {k - 1}], ' ') as phrase "
        f"from (select lang, w, unnest(range(1, len(w) - {k} + 2)) as i from p)" for k in range(1, LONGEST + 1))
    return f"""
with t as (select coalesce(lang, '{UNKNOWN}') as lang, unnest(regexp_split_to_array(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from t),
totals as (select lang, sum(len(w))::bigint as n from p group by lang),
counts as (select lang, size, phrase, count(*) as a from ({grams}) group by all having count(*) >= {min_count}),
found as (select lang, phrase, a, size, string_split(phrase, ' ') as w from counts where size > 1),
cuts as (select lang, phrase, a, w, unnest(range(1, size)) as k from found),
scored as (select c.lang, c.phrase, c.a, k, h.a as l, t.a as r, n,
    ((1000::hugeint * c.a * n) // (h.a::hugeint * t.a))::bigint as score
  from cuts c join counts h on h.lang = c.lang and h.phrase = array_to_string(w[1:k], ' ')
    join counts t on t.lang = c.lang and t.phrase = array_to_string(w[k + 1:], ' ')
    join totals on totals.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
starts as (select lang, a, size, w, unnest(range(1, size)) as s from found),
inside as (select lang, a, size, s, array_to_string(w[s:e], ' ') as phrase
  from (select *, unnest(range(s + 1, size + 1)) as e from starts) where e - s + 1 < size),
held as (select lang, phrase, max(a) as longer from inside group by lang, phrase),
kept as (select best.* from best left join held using (lang, phrase)
  where longer is null or 100 * longer < {SHARE} * best.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::int as rank, phrase, a, l, r, n, score from ranked where rank <= {top}"""
