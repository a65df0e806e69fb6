import numpy as np
import pandas as pd
from indicata.llm import neighbours as N
from indicata.llm.common import table


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        i = ids.index(q)
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(ids[j], d[j]) for j in order]
    return out


def recall_of(found, truth):
    hits = total = 0
    for q, want in truth.items():
        got = found[found.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, len(got) + 1))
        assert (np.diff(got["score"]) >= 0).all()
        exact = dict(want)
        for v, s in zip(got.vec_id, got.score):
            if v in exact:
                assert abs(exact[v] - s) < 1e-12
        hits += len(set(got.vec_id) & set(exact))
        total += len(want)
    return hits / total


def test_recall_on_embeddings(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    pdf = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.stack(pdf.embedding.to_numpy()).astype(float)
    found = N.nearest_vectors(rows).toPandas()
    truth = brute(pdf.vec_id.tolist(), x, [i for i in pdf.vec_id if i % 100 == 0])
    assert len(found) == 10 * len(truth)
    assert recall_of(found, truth) >= 0.9


def test_few_probes_suffice_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 100)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(32, 12)) * 6
    x = np.vstack([c + rng.normal(size=(60, 12)) for c in centres])
    x[500:900] = x[500]  # one vector holds a fifth of the rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    router = N.fit(x, len(x), parts=8)
    assert router.probes < 8
    found = N.search(df.where("vec_id % 100 = 0"), df, parts=8).toPandas()
    truth = brute(list(range(len(x))), x, range(0, len(x), 100))
    unique = {q: w for q, w in truth.items() if not 500 <= q < 900}
    assert recall_of(found, unique) >= 0.9
    same = found[found.query_id == 600]
    assert same.score.tolist() == [0.0] * 10 and same.vec_id.tolist() == list(range(500, 510))


def test_parts_are_balanced():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(640, 6))
    graph = N.nearest(x, 10)
    label = N.balanced_parts(x, graph, 8)
    assert np.bincount(label, minlength=8).max() <= np.ceil(1.1 * 80)
    cut = (label[graph] != label[:, None]).mean()
    assert cut < 0.6 < (rng.permutation(label)[graph] != label[:, None]).mean()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]),
            (None, [1.0, 1.0]), (600, [1.0, None]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as part", "2 as score")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in N.nearest_vectors(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 0), (100, 2, 0), (100, 3, 1), (100, 4, 2)]
    assert N.nearest_vectors(df.where("false")).count() == 0
