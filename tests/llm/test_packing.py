import random
import zlib

import numpy as np
import pyarrow as pa
from indicata.llm import packing as K
from indicata.llm.common import table


def check_plan(histogram, capacity):
    p = K.plan(histogram, capacity)
    fill = {}
    for length in np.flatnonzero(histogram):
        n = histogram[length]
        seq, off = p.place(np.full(n, length), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist()):
            fill.setdefault(s, []).append((o, int(length)))
    assert set(fill) == set(range(p.sequences))
    for parts in fill.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= capacity
    return p.sequences


def test_plans_are_gapless_and_tight():
    rng = np.random.default_rng(2)
    for capacity in (1, 7, 64, 512):
        for size in (0, 1, 30, 5000):
            h = np.bincount(rng.integers(1, capacity + 1, size), minlength=capacity + 1)
            n = check_plan(h, capacity)
            need = -(-int((h * np.arange(capacity + 1)).sum()) // capacity)
            assert n >= need
    short = np.bincount(rng.integers(1, 200, 5000), minlength=513)
    assert check_plan(short, 512) <= -(-int((short * np.arange(513)).sum()) // 512) + 1


def test_counts_fit_an_exact_histogram():
    h = np.zeros(65)
    h[40] = h[24] = 30
    h[32] = 20
    rows = K.patterns(np.flatnonzero(h), 64)
    x = K.fit_counts(rows, h)
    used = np.bincount(rows.ravel(), weights=np.repeat(x, 4), minlength=65)
    used[0] = 0
    assert np.abs(used - h).max() < 0.5 and (x >= 0).all()


def test_ids_are_the_tokenizers_ids():
    w = K.WordTokenizer.of(K.vocabulary())
    random.seed(3)
    texts = [f"{chr(c)}a{chr(c)}, {chr(c)}.{chr(c)}'s" for c in range(0x3000)]
    texts += ["".join(random.choice("aAzÉéßñ İıſΣςσ.,'!1 \n\t\r\x0b\x1c\x85\xa0́<|>") for _ in range(50)) for _ in range(3000)]
    texts += ["x <|endoftext|> y", "<|STARTOFTEXT|>", "", " ", "don't, I'll.", "a" * 5000]
    want = [np.array(e.ids, "<u4").tobytes() for e in w._encoder.encode_batch(texts, add_special_tokens=False)]
    assert w(pa.array(texts)) == want


def brute_pieces(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(K.vocabulary())
    out = []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            out.append((doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check_packed(docs):
    rows = K.packed_documents(docs).collect()
    want = brute_pieces([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted([tuple(r)[:5] for r in rows], key=str) == want
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    return len(fill), sum(r["length"] for r in rows)


def test_documents(spark):
    sequences, tokens = check_packed(table(spark, "/root/testdata/sf0.001", "documents"))
    assert sequences <= -(-tokens // 4096) + 1


def test_edges(odd_docs, no_docs):
    check_packed(odd_docs)
    assert K.packed_documents(no_docs).count() == 0
    kept = K.pack(odd_docs, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in kept)
