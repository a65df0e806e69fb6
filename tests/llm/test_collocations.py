import random
import re
from collections import Counter
from unittest import mock

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from indicata.llm import collocations as C
from indicata.llm import key_exchange as kx


def brute(rows, min_count, top=C.TOP):
    """Every occurrence counted, exact integers."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                counts.update((lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    out = {}
    for (lang, p), a in found.items():
        inside = any(g == lang and len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q)))
                     for (g, q), b in found.items())
        if not inside:
            n = totals[lang]
            score, k = min((1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, counts[lang, p[:k]], counts[lang, p[k:]], n))
    return sorted((lang, i + 1, r[2].decode(), *r[3:], -r[0]) for lang, rs in out.items()
                  for i, r in enumerate(sorted(rs)[:top]))


def made(seed, n):
    rng = random.Random(seed)
    words = "the of And cat sat Mat on ñu ß 漢 a-b".split()
    pool = [" ".join(rng.choices(words, k=rng.randint(2, 9))) for _ in range(12)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(1, 40)))
                 for _ in range(rng.randint(1, 6))]
        rows.append((rng.choice(["en", "de", None, "und"]), rng.choice([". ", ", ", "\n", " ", "\t", "  "]).join(parts)))
    return rows


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in C.collocations(docs, **more).collect())


@pytest.mark.parametrize("period, shard", [(C.PERIOD, C.SHARD_WORDS), (2, 300)])
def test_against_every_occurrence(spark, monkeypatch, period, shard):
    monkeypatch.setattr(C, "PERIOD", period)
    rows = made(period, 150) + [("en", None), ("en", ""), (None, " \t ,"), ("en", "cat " * 400)]
    assert run(spark, rows, min_count=6) == brute(rows, 6)
    assert run(spark, rows, min_count=6, top=3) == brute(rows, 6, 3)


def test_overlaps_are_counted_once(monkeypatch):
    monkeypatch.setattr(C, "PERIOD", 2)
    words = [f"w{i * 7 % 50}" for i in range(500)]
    texts = pa.array([" ".join(words), None, " . ", "w1 w2;" + "\t".join(words[:30])])
    seen, of = Counter(), Counter()
    for text, own, chunk in zip(*(x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() for x in C.chunks(texts))):
        held = chunk.split(" ")
        of[text] += own
        assert own <= len(held) <= own + C.LONGEST - 1
        if text == 0:
            for n in range(1, C.LONGEST + 1):
                seen.update(tuple(held[i:i + n]) for i in range(own) if i + n <= len(held))
    want = Counter(tuple(words[i:i + n]) for n in range(1, C.LONGEST + 1) for i in range(len(words) - n + 1))
    assert seen == want and of == {0: 500, 3: 32}


def test_shards_agree_on_hashes_and_exactness(monkeypatch):
    """Sequences whose hashes collide are told apart by their words."""
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "own": [6, 2], "chunk": ["a b a b a c", "a b"], "times": [3, 5]})
    with mock.patch.object(C, "TaskContext") as context:
        context.get().partitionId.return_value = 1
        row, = next(C._shards([batch])).to_pylist()
    shard = C.Shard(row)
    shard.frequent = {n: shard.left >= n for n in (1, 2)}
    name = lambda s: {(n, s.langs[s.word_lang[s.tokens[p]]], " ".join(s.words[t] for t in s.tokens[p:p + n])): c
                      for n, p, c in s.phrases()}
    want = {(1, "en", "a"): 9, (1, "en", "b"): 6, (1, "en", "c"): 3, (2, "en", "a b"): 6, (2, "en", "b a"): 6,
            (2, "en", "a c"): 3, (1, "de", "a"): 5, (1, "de", "b"): 5, (2, "de", "a b"): 5}
    assert name(shard) == want
    monkeypatch.setattr(C.Shard, "hashes", lambda self, n: self.tokens.astype("u8") * 0)
    assert name(shard) == want


def test_key_exchange(spark):
    rng = np.random.default_rng(5)
    shards = {i: np.unique(rng.integers(0, 1 << 48, 300, dtype=np.uint64) >> np.uint64(i % 2 * 40)) for i in range(6)}
    total = Counter(k for keys in shards.values() for k in keys.tolist())
    frame = pa.Table.from_batches([kx.dealt(i, k, np.ones(k.size, np.uint64), 7) for i, k in shards.items()])
    got = {r["shard"]: r["bits"] for r in kx.answers(spark.createDataFrame(frame.to_pandas(), kx.DEALT), (2, 3)).collect()}
    for i, keys in shards.items():
        two, three = kx.marks([b.asDict() for b in got[i]], 2)
        assert two.tolist() == [total[k] >= 2 for k in keys.tolist()]
        assert three.tolist() == [total[k] >= 3 for k in keys.tolist()]


def test_oracle_and_edges(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("lang", "text").collect()]
    got = sorted(tuple(r) for r in C.collocations(odd_docs, min_count=2).collect())
    assert got == brute([(g, t) for g, t in rows if not t or len(t) < 10 ** 5], 2) or got == brute(rows, 2)
    assert C.collocations(no_docs).count() == 0
    con = duckdb.connect()
    made_rows = made(4, 80)
    con.execute("create table documents (lang varchar, text varchar)")
    con.executemany("insert into documents values (?, ?)", made_rows)
    assert run(spark, made_rows, min_count=4) == sorted(con.execute(C.oracle(4)).fetchall())


def test_a_shard_names_its_phrases_in_a_row_for_each_bucket(spark, monkeypatch):
    """Rows that leave a shard do not grow with the phrases that it has; the counts stay those of each phrase."""
    rows = [("en\n", text) for _, text in made(8, 120)] + made(9, 60)
    sent = []
    named = C._named
    monkeypatch.setattr(C, "_named", lambda held, langs: sent.append((len(held), named(list(held), langs))) or sent[-1][1])
    with mock.patch.object(C, "TaskContext") as context:
        context.get().partitionId.return_value = 1
        counts = Counter(tuple(r) for r in rows)
        texts = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
        folded = pa.Table.from_batches(list(C._parse([texts])))
        shard = C.Shard(next(C._shards(folded.combine_chunks().to_batches())).to_pylist()[0])
    shard.frequent = {n: shard.left >= n for n in range(1, 6)}
    monkeypatch.setattr(C, "_told", lambda row, rounds: shard)
    out = pa.Table.from_batches(list(C._name(5)([pa.RecordBatch.from_pydict({"shard": [1]})])))
    assert out.num_rows == 5 and sent[0][0] > 100 and sum(counts.values()) == len(rows)
    got = Counter()
    for b in range(5):
        part = C._sum_named(3)(out.filter(pa.compute.equal(out.column("bucket"), b)))
        got.update({(r["lang"], tuple(r["phrase"].split(" "))): r["a"] for r in part.to_pylist()})
        assert all(r["size"] == len(r["phrase"].split(" ")) for r in part.to_pylist())
    want = Counter()
    for lang, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            for n in range(1, 6):
                want.update(("und" if lang is None else lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    assert got == Counter({k: a for k, a in want.items() if a >= 3})
