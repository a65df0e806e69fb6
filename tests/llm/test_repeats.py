import hashlib
import random

import duckdb
import numpy as np
import pytest
from indicata.llm import repeats as R


def brute(rows, length):
    """(id, bytes, removed, spans, sha256) with every string in a dictionary."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    place = lambda i: R._NULL if i is None else i
    least = {}
    for i, t in raw:
        for p in range(len(t) - length + 1):
            s = t[p:p + length]
            least[s] = min(least.get(s, R._NULL), place(i))
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if least[t[p:p + length]] < place(i):
                gone[p:p + length] = b"\1" * length
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length=50, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = R.strip_repeats(docs, length=length, **more)
    return sorted([tuple(r)[:5] for r in got.collect()], key=str)


def texts(seed, n, words, share):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices(words, k=rng.randint(3, 30))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = [rng.choice(pool) if rng.random() < share else " ".join(rng.choices(words, k=rng.randint(0, 25)))
                 for _ in range(rng.randint(0, 6))]
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("words, length", [("alpha beta gamma delta épsilon 漢字".split(), 50), (["a", "b"], 24), (["\0", "\0\0"], 30)])
def test_against_every_string(spark, words, length):
    rows = list(enumerate(texts(len(words), 60, words, 0.4)))
    rows += [(5, rows[3][1]), (5, rows[4][1]), (None, rows[3][1]), (None, rows[3][1]), (100, None), (101, ""), (102, "x" * 400), (-3, "x" * 90)]
    want = brute(rows, length)
    assert run(spark, rows, length) == want
    assert run(spark, rows, length, hot=1) == want  # every string dealt singly


def test_many_shards_and_merges(spark, monkeypatch):
    """Shards of a few pieces each: results come through the merge alone."""
    monkeypatch.setattr(R, "SHARD_BYTES", 700)
    rows = list(enumerate(texts(9, 40, "one two three four five six".split(), 0.5)))
    shard = [R.Documents(_row(n, rows[n::4]), 50) for n in range(4)]
    buckets = 1
    keys = np.concatenate([s.keys()[0] for s in shard])
    known, where = np.unique(keys, return_inverse=True)
    total = np.bincount(where, np.concatenate([s.keys()[1] for s in shard]).astype(float))
    pieces = []
    for s in shard:
        twice = total[np.searchsorted(known, s.keys()[0])] >= 2
        bits = np.packbits(twice).tobytes() + np.packbits(np.zeros(twice.size, bool)).tobytes()
        s.told = s.shared([{"n": twice.size, "bits": bits}], buckets)
        pieces.append(s.told.rows(s.number))
    import pyarrow as pa
    answers = {r["shard"]: r for r in R._resolve(50)(pa.Table.from_batches(pieces)).to_pylist()}
    got = {}
    for s in shard:
        gone = R._mark(s, s.told, [answers[s.number]])
        for i, (a, b) in zip(s.ids.tolist(), zip(np.append(0, s.ends[:-1]).tolist(), s.ends.tolist())):
            got[i] = int(gone[a:b].sum())
    assert got == {r[0]: r[2] for r in brute(rows, 50)}


def _row(number, rows):
    import pyarrow as pa
    from unittest import mock
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["i", "t"])
    with mock.patch.object(R, "TaskContext") as context, mock.patch.object(R, "SHARD_BYTES", 1 << 30):
        context.get().partitionId.return_value = 0
        row = next(R._pack([batch])).to_pylist()[0]
    return row | {"shard": number}


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(3)
    for n, k in ((0, 1), (1, 1), (40, 3), (600, 1), (3000, 2), (500, 200)):
        text = np.append(rng.integers(0, k, n).astype(np.uint8), R._GUARD)
        raw, order = text.tobytes(), R.suffix_array(text)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: raw[i:])
        want = [0]
        for a, b in zip(order, order[1:]):
            m = 0
            while m < 50 and raw[a + m:a + m + 1] == raw[b + m:b + m + 1] != b"":
                m += 1
            want.append(m)
        assert R.common_prefixes(text, order).tolist() == want


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(1)
    a, b, same = ("".join(rng.choices("abc ", k=n)).encode() for n in (301, 77, 400))
    one, two = (R.anchors(np.frombuffer(x + same + x, np.uint8)) for x in (a, b))
    assert (one[len(a):len(a) + 351] == two[len(b):len(b) + 351]).all()


def test_oracle_and_edges(spark, odd_docs, no_docs):
    documents = odd_docs.select("doc_id", "text").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("create table documents as select cast(doc_id as bigint) as doc_id, text from documents where length(text) < 100000")
    got = sorted([tuple(r) for r in R.repeats_report(odd_docs).collect()], key=str)
    assert got == brute([tuple(r) for r in odd_docs.select("doc_id", "text").collect()], 50)
    short = odd_docs.where("text is null or length(text) < 100000")
    con.execute("insert into documents select doc_id, null from (select 2 as doc_id)")
    assert sorted([tuple(r) for r in R.repeats_report(short).collect()], key=str) == sorted(con.execute(R.oracle()).fetchall(), key=str)
    assert R.repeats_report(no_docs).count() == 0
    spans = {r["doc_id"]: r["spans"] for r in R.strip_repeats(odd_docs).collect() if r["doc_id"]}
    assert spans[1] == [] and spans[7] == []
