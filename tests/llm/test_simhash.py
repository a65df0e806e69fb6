import numpy as np
import xxhash
from indicata.llm import simhash as S
from indicata.llm.common import table
from indicata.llm.components import components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_is_the_brute_force_one():
    texts = ["A b\tC d e\x0bf", "one", "a b c d", "", None, "É é ß", "x\xa0y z w v u", "w " * 700]
    assert [S.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_trie_links_every_near_pair():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    codes = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, 8), replace=False)
            codes.add(int(s) ^ sum(1 << int(f) for f in flips))
    codes = sorted(codes)
    root = S.trie_links(np.array(codes, np.uint64), 64)
    want = brute_components(codes)
    assert len(set(zip(root.tolist(), want))) == len(set(want)) == len(set(root.tolist()))


def test_links_with_large_groups_dealt_anew(spark):
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 2 ** 63))
    codes = sorted({base ^ sum(1 << int(f) for f in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(400)})
    signed = [c - 2 ** 64 if c >= 2 ** 63 else c for c in codes]
    edges = S.links(spark.createDataFrame([(c,) for c in signed], "fp long"), group_rows=20)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    want = brute_components(codes)
    pairs = {(got.get(s, s), w) for s, w in zip(signed, want)}
    assert len(pairs) == len(set(want)) == len({a for a, _ in pairs})


def test_documents_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_groups(docs).collect()}
    assert got == {rows[i][0]: (f"{fps[i]:016x}", rows[comp[i]][0]) for i in range(len(rows))}


def test_edges(odd_docs, no_docs):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.simhash_groups(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    comp = {i: c for i, _, c in got}
    assert comp[2] == comp[3] == comp[4] == 2 and comp[8] == 1 and comp[None] == 1
    assert S.simhash_groups(no_docs).count() == 0
    kept = S.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"]) == [
        (False, i) for i in (1, 2, 5, 6, 7, 9)]
    assert kept.where("doc_id is null").count() == 0  # a copy of document 1
    assert S.keep_first(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_no_text_is_lost_to_a_repeated_or_missing_id(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    c, d = "red orange yellow green blue indigo violet", "do re mi fa so la ti"
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "x"), (2, b, "y"), (3, c, "y"), (None, c, "z"), (None, d, "z"), (None, d, "z"), (4, None, "w"), (None, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(4)
    kept = sorted((tuple(r) for r in S.keep_first(docs).collect()), key=str)
    assert kept == sorted([(1, a, "x"), (1, b, "x"), (3, c, "y"), (None, d, "z"), (4, None, "w")], key=str)


def test_near_texts_of_one_id_leave_one_row(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (5, text + " more"), (6, text + " other"), (5, text + " more")]
    got = S.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0]["doc_id"] == 5
