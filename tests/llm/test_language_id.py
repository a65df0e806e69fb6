import zlib

import numpy as np
import pandas as pd
from indicata.llm import language_id as L
from indicata.llm.common import table


def test_held_out_accuracy_and_contract(spark):
    got = L.language_id(table(spark, "/root/testdata/sf0.01", "documents")).toPandas().set_index("doc_id")
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id")
    assert sorted(got.index) == sorted(docs.index)
    held = pd.Series({i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.index})
    assert (got["held_out"] == held.loc[got.index]).all()
    both = got.join(docs["lang"])[got["held_out"]]
    assert (both["lang_pred"] == both["lang"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_scores_equal_a_brute_force_sum():
    rng = np.random.default_rng(1)
    m = L.Model(("a", "b"), np.log([0.3, 0.7]), np.hstack([rng.normal(size=(2, L.BUCKETS)), np.zeros((2, 1))]).astype(np.float32))
    texts = ["Abc, dé", "x", "zwei Wörter 12", None, "", "99"]
    labels, score = L.score_texts(m, texts)
    for t, lab, s in zip(texts, labels, score):
        if not t or not any(c.isalpha() for c in t):
            assert (lab, s) == ("und", 0)
            continue
        total = m.log_prior.copy()
        cps = [int(c) for c in L._code_points(t)]
        for n in L.ORDERS:
            for i in range(len(cps) - n + 1):
                h = 0
                for k in range(n):
                    h = ((h * 0x01000193) ^ (cps[i + k] + k + 1)) & 0xFFFFFFFF
                h = (h * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
                h = (h * 0x85EBCA77) & 0xFFFFFFFF
                total += m.log_prob[:, h >> (32 - 15)]
        p = np.exp(total - total.max())
        assert lab == m.labels[int(total.argmax())]
        assert abs(s - p.max() / p.sum()) < 1e-6


def test_edges(odd_docs, no_docs):
    got = L.language_id(odd_docs).toPandas()
    assert len(got) == odd_docs.count()
    by_id = got.dropna(subset=["doc_id"]).drop_duplicates().set_index("doc_id")
    assert set(by_id.loc[[2, 3, 4, 6], "lang_pred"]) == {"und"}
    assert L.language_id(no_docs).count() == 0
    kept = L.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 5, 7, 8, 9, None}
    assert L.keep_identified(no_docs).count() == 0
