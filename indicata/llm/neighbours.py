"""Approximate nearest neighbours by learned partitions.

1. From a bounded sample (``SAMPLE`` vectors of lowest hash) the graph of each
   vector's nearest neighbours is built and cut into parts of equal size that
   break few edges: a balanced start by recursive bisection, then rounds of
   label moves that respect the capacity.
2. A small network learns to tell a vector's part, with its neighbours' parts
   as soft labels.  It is the index: one pass sends every row to its most
   probable part.
3. A query goes to as many of its most probable parts as the sample needed for
   ``RECALL`` of its true neighbours, and is compared exactly with all rows
   there, in double precision.

Rows and queries meet by (part, row block, query block): parts with many rows,
a hot vector's included, are dealt into blocks of about ``BLOCK`` rows, so no
task holds a part whole.  Every block returns its own ten best per query and a
second step picks the best ten of them.

Edge cases: rows with a null id, a null vector, a vector with null, NaN or
infinite components, of zero length or of another dimension than the sample's
most frequent one take no part; equal distances go to the smaller id; a
repeated query id is searched once, with the smallest of its vectors; with too
few rows to cut a graph there is one part and the search is exact; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indicata.llm.common import cut

SAMPLE, NEIGHBOURS, RECALL = 8192, 10, 0.95
BLOCK, QUERY_BLOCK = 16_384, 1024


# --- the partitioned graph ----------------------------------------------------

def nearest(x: np.ndarray, k: int, step: int = 1024) -> np.ndarray:
    """Positions of the ``k`` nearest other rows of each row of ``x``."""
    norm = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), step):
        d = norm[None, :] - 2 * x[i:i + step] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i:i + step] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _halves(x: np.ndarray, rows: np.ndarray, parts: int, out: np.ndarray, first: int) -> None:
    """Equal parts by splitting at the median of the leading direction, again and again."""
    if parts == 1:
        out[rows] = first
        return
    c = x[rows] - x[rows].mean(0)
    v = np.linalg.eigh(c.T @ c)[1][:, -1]
    order = rows[np.argsort(c @ v, kind="stable")]
    h = len(order) // 2
    _halves(x, order[:h], parts // 2, out, first)
    _halves(x, order[h:], parts // 2, out, first + parts // 2)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 20, slack: float = 1.1) -> np.ndarray:
    """A part for each vertex: few graph edges between parts, at most ``slack`` times the mean size."""
    label = np.zeros(len(x), np.int64)
    _halves(x, np.arange(len(x)), parts, label, 0)
    most = int(np.ceil(slack * len(x) / parts))
    a = np.repeat(np.arange(len(x)), graph.shape[1])
    b = graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.float32)
        np.add.at(votes, (a, label[b]), 1)
        now = votes[np.arange(len(x)), label]
        want = votes.argmax(1)
        gain = votes.max(1) - now
        movers = np.flatnonzero((gain > 0) & (want != label))
        if not movers.size:
            break
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        for i in movers[np.argsort(-gain[movers], kind="stable")]:
            if sizes[want[i]] < most and sizes[label[i]] > 1:
                sizes[label[i]] -= 1
                sizes[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Router:
    """One hidden layer; ``probes`` parts answer a query."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def dim(self) -> int:
        return len(self.mean)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) * self.scale).astype(np.float32) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 25, batch: int = 256,
                 rate: float = 2e-3, seed: int = 7) -> Router:
    """Cross-entropy against soft labels, by Adam."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    scale = float(1 / max(x.std(), 1e-12))
    z = ((x - mean) * scale).astype(np.float32)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)).astype(np.float32), np.zeros(hidden, np.float32),
         rng.normal(0, (1 / hidden) ** 0.5, (hidden, target.shape[1])).astype(np.float32),
         np.zeros(target.shape[1], np.float32)]
    m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for i in range(0, len(z), batch):
            xb, yb = z[order[i:i + batch]], target[order[i:i + batch]]
            h = np.maximum(xb @ p[0] + p[1], 0)
            o = h @ p[2] + p[3]
            e = np.exp(o - o.max(1, keepdims=True))
            d = (e / e.sum(1, keepdims=True) - yb) / len(xb)
            dh = (d @ p[2].T) * (h > 0)
            t += 1
            for j, g in enumerate((xb.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] -= rate * (m[j] / (1 - 0.9 ** t)) / (np.sqrt(v[j] / (1 - 0.999 ** t)) + 1e-8)
    return Router(mean, scale, *p, probes=1)


def fit(x: np.ndarray, rows: int, parts: int | None = None, recall: float = RECALL) -> Router:
    """The index of ``rows`` vectors of which ``x`` is the sample.

    Parts grow with the square root of the row count, as far as the sample
    can teach them; the number of probes is the smallest that finds ``recall``
    of the true neighbours of sample vectors the network did not see.
    """
    k = NEIGHBOURS
    if parts is None:
        parts = 2 ** int(np.log2(max(1.0, min(rows ** 0.5 / 8, len(x) / 128))))
    if parts < 2 or len(x) < 4 * k:
        dim = x.shape[1] if x.size else 1
        return Router(np.zeros(dim), 1.0, np.zeros((dim, 1), np.float32), np.zeros(1, np.float32),
                      np.zeros((1, 1), np.float32), np.zeros(1, np.float32), 1)
    graph = nearest(x, k)
    label = balanced_parts(x, graph, parts)
    soft = np.zeros((len(x), parts), np.float32)
    np.add.at(soft, (np.repeat(np.arange(len(x)), k), label[graph].ravel()), 0.5 / k)
    soft[np.arange(len(x)), label] += 0.5
    held = np.arange(len(x)) % 5 == 0
    router = train_router(x[~held], soft[~held])
    logits = router.logits(x)
    home = logits.argmax(1)
    ranks = np.argsort(np.argsort(-logits[held], axis=1, kind="stable"), axis=1)
    need = np.sort(np.take_along_axis(ranks, home[graph[held]], 1).ravel())
    probes = int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1
    return Router(router.mean, router.scale, router.w1, router.b1, router.w2, router.b2, probes)


# --- the search ----------------------------------------------------------------

def usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part; v is an array of doubles."""
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return out.where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda c: c != 0))


def _routed(router, most_probable: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = router.value
        for batch in batches:
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, r.dim)
            logits = r.logits(x)
            if most_probable:
                parts = logits.argmax(1)[:, None]
            else:
                parts = np.argsort(-logits, axis=1, kind="stable")[:, :r.probes]
            at = np.repeat(np.arange(batch.num_rows), parts.shape[1])
            yield pa.RecordBatch.from_arrays(
                [c.take(pa.array(at)) for c in batch.columns] + [pa.array(parts.ravel().astype(np.int32))],
                names=["vec_id", "v", "part"])
    return run


def _block_search(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            x, ids = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy()
            q_ids = queries["vec_id"].to_numpy()
            norm = (x * x).sum(1)
            for i in range(0, len(queries), 64):
                q = np.stack(queries["v"].to_numpy()[i:i + 64])
                size = (q * q).sum(1)
                d = np.maximum(norm[None, :] - 2 * q @ x.T + size[:, None], 0)
                d[q_ids[i:i + 64, None] == ids[None, :]] = np.inf
                edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                for j in range(len(q)):
                    # a margin for the rounding of the expanded form, then the exact measure
                    near = np.flatnonzero((d[j] <= edge[j] + 1e-9 * (size[j] + norm.max())) & (d[j] < np.inf))
                    score = np.sqrt(((x[near] - q[j]) ** 2).sum(1))
                    best = np.lexsort((ids[near], score))[:k]
                    out.append(pd.DataFrame({"query_id": q_ids[i + j], "vec_id": ids[near[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return run


def search(queries: DataFrame, rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
           k: int = NEIGHBOURS, parts: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each query."""
    spark = rows.sparkSession
    rows, queries = usable(rows, id_col, vector), usable(queries, id_col, vector)
    total = rows.count()
    # thinned in the tasks first, so that all tasks together send about ``sample`` rows
    thin = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total // sample))) == 0
    chosen = rows.where(thin).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    sizes = chosen["v"].map(len)
    dim = int(sizes.mode().iloc[0]) if len(chosen) else 1
    x = np.stack(chosen["v"][sizes == dim].to_numpy()) if len(chosen) else np.zeros((0, 1))
    router = spark.sparkContext.broadcast(fit(x, total, parts))
    schema = "vec_id long, v array<double>, part int"
    same = F.size("v") == dim
    homed = rows.where(same).mapInArrow(_routed(router, True), schema)
    asked = (queries.where(same).groupBy("vec_id").agg(F.min("v").alias("v"))
             .mapInArrow(_routed(router, False), schema))
    # blocks: as many per part as its rows and its queries need (one number per part)
    homed, asked = cut(homed), cut(asked)
    n_rows = {r["part"]: r["n"] for r in homed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    n_asked = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame(
        [(p, -(-n // BLOCK), -(-n_asked[p] // QUERY_BLOCK)) for p, n in n_rows.items() if p in n_asked],
        "part int, row_blocks int, query_blocks int")
    blocks = F.broadcast(blocks)  # one row per part
    spread = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30))
    left = (asked.join(blocks, "part").withColumn("qb", (spread % F.col("query_blocks")).cast("int"))
            .withColumn("rb", F.explode(F.expr("sequence(0, row_blocks - 1)"))))
    # rows of one id are dealt apart as well: the block also hangs on the row's place in its task
    deal = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("row_blocks")).cast("int")
    right = (homed.join(blocks, "part").withColumn("rb", deal)
             .withColumn("qb", F.explode(F.expr("sequence(0, query_blocks - 1)"))))
    keys, cols = ["part", "rb", "qb"], ["part", "rb", "qb", "vec_id", "v"]
    found = (left.select(*cols).groupBy(*keys).cogroup(right.select(*cols).groupBy(*keys))
             .applyInPandas(_block_search(k), "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_vectors(rows: DataFrame) -> DataFrame:
    """The ten nearest rows of every row whose vec_id is divisible by 100."""
    return search(rows.where("vec_id % 100 = 0"), rows)
