import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from indicata.llm import pii as P
from indicata.llm.common import table

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                  "card": lambda: 14 <= len(d) <= 19 and P.luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-% 01259()_é\n", max_size=60))
def test_base_spans_are_the_contract_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = P.train(docs)
    assert set(model) == set(P.KINDS)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    extra = 0
    for r in P.find(docs, model).collect():
        want = brute(text[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s[2] == k for s in want) for k in P.KINDS]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
        extra += len([s for s in r["spans"].split(",") if s]) - len(want)
    assert extra <= 20  # plain prose is left alone
    # two cards with a space between are one failing match of the base rule; each is found by the model
    pair = "paid with 4111111111111111 5500000000000004 on monday"
    assert not P.base_spans(pair) and P.spans(pair, model)[1] == [(10, 26, "card"), (27, 43, "card")]
    for clean in ("order 4111111111111112 shipped", "release 1.2.3.400 is out", "from 1234567 to 7654321 units",
                  "on 2023-11-05 12:30 sharp", "read 978-3-16-148410-0 first"):
        assert P.spans(clean, model)[1] == []
    forms = ["write to jan.dove(at)mail(dot)example(dot)org today", "ring 00498915551234 now"]
    assert sum(bool(P.spans(f, model)[1]) for f in forms) >= 1  # rewritten forms are found


def test_boosting_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    t = P.calibrated(P.boost(x[:400], y[:400]), x[400:], y[400:], 0.95)
    chosen = t.margin(x[400:]) >= t.threshold
    assert chosen.any() and y[400:][chosen].mean() >= 0.95
    none = P.calibrated(P.boost(x[:400], y[:400]), x[400:], 0 * y[400:], 0.95)
    assert none.threshold == np.inf


def test_edges(odd_docs, no_docs):
    rows = P.personal_data(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r["doc_id"]: r for r in rows}
    assert got[2]["spans"] == "" and got[9]["n_email"] == 1 and got[9]["n_phone"] == 1
    assert P.personal_data(no_docs).count() == 0
    clean = P.redact(odd_docs)
    assert clean.columns == odd_docs.columns and dict(clean.dtypes) == dict(odd_docs.dtypes)
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert texts[2]["text"] is None and texts[2]["n_chars"] is None
    assert "[EMAIL]" in texts[9]["text"] and "[PHONE]" in texts[9]["text"]
    assert texts[9]["n_chars"] == len(texts[9]["text"])
    assert texts[1]["text"] == "The quick brown fox jumps over the lazy dog."
    assert P.redact(no_docs).count() == 0


def test_masking_merges_overlaps():
    assert P.masked("abcdefgh", [(1, 4, "ip"), (3, 6, "card"), (7, 8, "phone")]) == "a[IP]g[PHONE]"


def test_adjoining_numbers(spark):
    model = P.train(table(spark, "/root/testdata/sf0.01", "documents"))

    def found(text):
        return [(text[a:b], k) for a, b, k in P.spans(text, model)[1]]
    card, other = "4111 1111 1111 1111", "5500 0000 0000 0004"
    for text in (f"paid with {card} 12/27 today", f"paid with {card} 2027 today"):
        assert not P.base_spans(text) and found(text) == [(card, "card")]
    assert found(f"paid with {card} {other} on monday") == [(card, "card"), (other, "card")]
    proposed = P.candidates("ring 555-123-4567 555-987-6543 now")
    assert {(5, 17, "phone"), (18, 30, "phone")} <= set(proposed)
    assert P.candidates("write to jan at mail.example.org")[-1] == (9, 32, "email")
    assert P.candidates("a call at noon. then") == []
    long_ = "1234 " * 5000
    assert len(P.candidates(long_)) < 25_000  # windows of at most 19 digits
