import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from indicata.llm import lexical_search as S


def brute(docs, items, k=10):
    """Every document scored for every item."""
    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t)

    held = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        wanted, found = Counter(words(text)), []
        for i, tf, n in held:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, c in wanted.items() if t in tf)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def made(seed, n, vocabulary):
    rng = random.Random(seed)
    words = [f"{c}{i}" for c in "aéZ漢" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda k: rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=k))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n)]
    docs += [(i + 10_000, t) for i, t in docs[:40]] + [(3, docs[5][1]), (3, docs[5][1]), (None, docs[5][1]), (500_000, None)]
    return docs, [(i, text(rng.randint(0, 15))) for i in range(25)] + [(7, docs[5][1]), (None, "a0 a0 A1"), (99, None), (98, "nowhere")]


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r) for r in S.search(d, i, **more).collect()], key=str)


@pytest.mark.parametrize("seed, n, vocabulary", [(1, 600, 30), (2, 900, 200)])
def test_against_every_score(spark, seed, n, vocabulary):
    docs, items = made(seed, n, vocabulary)
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, k=1) == brute(docs, items, 1)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(S, "ITEM_CHARS", 120)
    docs, items = made(3, 120, 20)
    assert run(spark, docs, items) == brute(docs, items)


def index(seed, n=400, width=60):
    rng = np.random.default_rng(seed)
    lists = [np.sort(rng.choice(width, rng.integers(1, 12), replace=False)) for _ in range(n)]
    offsets = np.append(0, np.cumsum([x.size for x in lists]))
    return offsets, np.concatenate(lists), rng.integers(1, 10 ** 9, offsets[-1]), width


def test_summaries_are_the_coordinatewise_maximum():
    offsets, term, impact, width = index(1)
    x = S.BlockIndex(offsets, term, impact, width, block=8)
    docs_of = [set(x.docs[a:b].tolist()) for a, b in zip(x.starts, x.starts[1:])]
    assert max(map(len, docs_of)) <= 16
    for t in range(width):
        own = docs_of[x.lists[t]:x.lists[t + 1]]
        have = {d for d in range(offsets.size - 1) if t in term[offsets[d]:offsets[d + 1]]}
        assert set().union(*own) == have and sum(map(len, own)) == len(have)
    most = {}
    for b, docs in enumerate(docs_of):
        for d in docs:
            for t, v in zip(term[offsets[d]:offsets[d + 1]].tolist(), impact[offsets[d]:offsets[d + 1]].tolist()):
                most[t, b] = max(most.get((t, b), 0), v)
    got = {(t, int(b)): int(v) for t in range(width)
           for b, v in zip(x.in_block[x.of_term[t]:x.of_term[t + 1]], x.most[x.of_term[t]:x.of_term[t + 1]])}
    assert got == most
    wide = S.BlockIndex(offsets, term, impact << 30, width, block=8)  # too wide for one word: the other sort
    assert (wide.most == x.most << 30).all() and (wide.in_block == x.in_block).all()


def test_blocks_are_skipped_and_none_too_many(monkeypatch):
    offsets, term, impact, width = index(2, 2000)
    x = S.BlockIndex(offsets, term, impact, width, block=8)
    scored = []
    real = S.BlockIndex.scores
    monkeypatch.setattr(S.BlockIndex, "scores", lambda self, d, q: scored.append(d.size) or real(self, d, q))
    wanted, times, query = np.array([3, 10, 40]), np.array([1, 2, 1]), np.zeros(width, np.int64)
    query[wanted] = times
    best = S.Best(5)
    x.search(wanted, times, wanted, query, best, np.arange(2000), np.zeros(2000, bool))
    full = real(x, np.arange(2000), query)
    order = np.lexsort((np.arange(2000), -full))[:5]
    assert best.ids.tolist() == order.tolist() and best.score.tolist() == full[order].tolist()
    assert 0 < sum(scored) < (full > 0).sum() / 2


def test_essential_lists():
    most = np.array([5, 100, 1, 40])
    wanted, times = np.array([0, 1, 2, 3]), np.array([1, 1, 3, 1])
    assert sorted(S.essential(wanted, times, most, 0).tolist()) == [0, 1, 2, 3]
    assert sorted(S.essential(wanted, times, most, 9).tolist()) == [1, 3]  # 3 + 5 < 9
    assert sorted(S.essential(wanted, times, most, 8).tolist()) == [0, 1, 3]


def test_oracle_and_edges(spark, odd_docs, no_docs):
    items = [(1, "quick fox"), (2, None), (3, "漢字 née +1 555"), (4, "alpha omicron alpha")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in S.search(odd_docs, frame).collect()], key=str) == brute(rows, items)
    assert S.search(no_docs, frame).count() == 0 and S.search(odd_docs, frame.where("false")).count() == 0
    docs, items = made(5, 200, 40)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", items)
    assert sorted(con.execute(S.oracle()).fetchall(), key=str) == brute(docs, items)
