import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from indicata.llm import order_minhash as O
from indicata.llm.common import table

M = (1 << 64) - 1


def mix(h):
    h = ((h ^ (h >> 33)) * 0xFF51AFD7ED558CCD) & M
    h = ((h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53) & M
    return h ^ (h >> 33)


def brute_signatures(text):
    """The method stated plainly: number the k-mers, take the smallest, order them, hash the tuple."""
    h = [ord(c) for c in text]
    if not h:
        return [0] * O.SIGNATURES
    if len(h) < O.K:
        h = [int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")]
    else:
        w = 1
        while w < O.K:
            h = [(h[i] * (0x9E3779B97F4A7C15 + 2 * w) + h[i + w]) & M for i in range(len(h) - w)]
            h = [x ^ (x >> 29) for x in h]
            w *= 2
    h = [mix(x) for x in h]
    seen, numbered = {}, []
    for x in h:
        key = x >> O._POSITION_BITS
        n = seen.get(key, 0)
        seen[key] = n + 1
        numbered.append(mix((x + n * 0xD6E8FEB86659FD93) & M) if n else x)
    out = []
    for seed, odd in zip(O._SEEDS[:, 0].tolist(), O._ODD[:, 0].tolist()):
        ranked = sorted(range(len(numbered)), key=lambda i: (((numbered[i] ^ seed) * odd) & M, i))
        v = 0
        for i in sorted(ranked[:O.SELECT]):
            v = mix((v * 31 + numbered[i]) & M)
        out.append(v >> 32)
    return out


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab é漢", max_size=80))
def test_signatures_are_the_brute_force_ones(text):
    assert O.signatures(text).tolist() == brute_signatures(text)


def test_long_texts_pass_in_columns():
    text = " ".join(str(i * i) for i in range(6000))
    assert len(text) > 2 * O._COLUMNS
    assert O.signatures(text).tolist() == brute_signatures(text)


@given(st.lists(st.integers(0, 3), min_size=2, max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=4))
def test_places_are_those_of_a_plain_sort(high, low):
    # hashes that are equal in the packed bits, and differ below them or not
    h = (np.array(high, np.uint64) << np.uint64(50)) | np.resize(np.array(low, np.uint64), len(high))
    assert np.array_equal(O._sorted_places(h), np.argsort(h, kind="stable"))


def test_one_numbering_below_and_beyond_the_packed_sort():
    edge = 1 << O._POSITION_BITS
    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(97, 101, edge + O.K + 9)))  # 4 letters: each k-mer occurs some 16 times
    beyond, below = O.numbered_kmers(text), O.numbered_kmers(text[:edge + O.K - 2])
    assert below.size == edge - 1 and beyond.size > edge
    assert np.array_equal(below, beyond[:below.size])
    first = {}
    for i in rng.integers(0, edge - 1, 300):
        first.setdefault(text[i:i + O.K], set()).add(int(below[i]))
    # occurrences of a k-mer have hashes of their own
    assert np.unique(beyond).size == beyond.size and len(first) > 200


def test_order_matters():
    words = [f"w{i * i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[200:] + words[:200])
    near = " ".join(words[:390] + ["x"] * 10)
    assert O.likeness(O.signatures(a), O.signatures(near)) > 0.7
    assert O.likeness(O.signatures(a), O.signatures(b)) < O.likeness(O.signatures(a), O.signatures(near))


def check(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))  # only equal rows share an id here
    want = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = O.signatures(text), O.signatures(edited), O.signatures(after)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), O.as_text(a), O.as_text(b),
                     float((a == b).mean()), float((a == c).mean())))
    assert sorted(map(tuple, O.edit_report(docs).collect()), key=str) == sorted(want, key=str)


def test_documents(spark):
    check(table(spark, "/root/testdata/sf0.001", "documents"))


def test_edited_texts_are_nearer_than_the_next_document(spark):
    rows = O.edit_report(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.98 * len(rows)


def test_edges(odd_docs, no_docs):
    check(odd_docs)
    check(odd_docs.where("doc_id = 1"))
    assert O.edit_report(no_docs).count() == 0
    got = {r["id"]: r["fingerprint"] for r in O.fingerprints(odd_docs).collect()}
    assert got[1] == got[8] and got[2] == got[3] == "0" * 8 * O.SIGNATURES
