import textwrap

import duckdb
import pytest
from indicata.llm import licenses as L
from indicata.llm.common import table


def check(spark, docs):
    got = sorted(map(tuple, L.scan(docs).collect()), key=str)
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    con.execute("create table documents as select cast(doc_id as bigint) as doc_id, text from documents")
    assert got == sorted(con.execute(L.oracle()).fetchall(), key=str)
    return {r[0]: r for r in got}


def test_documents(spark):
    got = check(spark, table(spark, "/root/testdata/sf0.01", "documents"))
    assert {"MIT", "GPL-3.0", "Apache-2.0", "CC-BY-NC-4.0"} <= {r[3] for r in got.values()}


def test_rules_need_their_order(spark):
    s = L.SENTENCES
    docs = spark.createDataFrame([
        (1, s["bsd-grant"] + "\nother text. " + s["bsd-source"] + " " + s["bsd-binary"]),
        (2, s["bsd-grant"] + "\n" + s["bsd-binary"] + "\n" + s["bsd-source"]),
        (3, s["mit-grant"].upper() + "\n  " + s["mit-keep"].replace(" ", "  ") + "\n" + s["mit-asis"]),
        (4, "\n".join(s.values())),
        (5, "the license is not named here"),
        (6, "\n".join([s["gpl-free"] + " " + s["gpl-version"], s["gpl-hope"], s["gpl-more"]])),
    ], "doc_id long, text string")
    got = check(spark, docs)
    assert [got[i][3] for i in (1, 2, 3, 5, 6)] == ["BSD-2-Clause", "", "MIT", "", "GPL-3.0"]
    assert set(got[4][3].split(",")) == {name for name, _ in L.RULES}


def test_every_sentence_and_rule_is_reachable():
    table = L.sentence_table()
    assert len(table) == len(L.SENTENCES)
    assert {i for _, needed in L.RULES for i in needed} <= set(L.SENTENCES)
    with pytest.raises(ValueError):
        L.sentence_table({"x": "Two sentences. Permission."})


def test_edges(spark, odd_docs, no_docs):
    assert len(check(spark, odd_docs)) == 10 and L.scan(odd_docs).count() == odd_docs.count()
    assert L.scan(no_docs).count() == 0


def test_plan_is_native(spark):
    plan = L.scan(table(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_wrapped_licenses(spark):
    needs = [("Apache-2.0", ["apache-notice", "apache-comply", "apache-copy", "apache-asis", "apache-see"]),
             ("MIT", ["mit-grant", "mit-keep", "mit-asis"]), ("ISC", ["isc-grant"]),
             ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
             ("GPL-3.0", ["gpl-free", "gpl-version", "gpl-hope", "gpl-more"])]
    rows, want = [], {}
    for name, ids in needs:
        for width in (20, 72):
            for prefix, feed in (("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("// ", "\n"), (";; ", "\n"), ("dnl ", "\n")):
                whole = [textwrap.wrap(L.SENTENCES[i], width, break_long_words=False, break_on_hyphens=False) for i in ids]
                text = feed.join(prefix + line for part in [["Some title"], [""], *whole, ["the end"]] for line in part)
                want[len(rows)] = (name, ",".join(ids))
                rows.append((len(rows), text))
    # a blank line or a mark ends a sentence; "free" and "software" may be on two lines
    rows += [(1000, L.SENTENCES["isc-grant"].replace("any purpose", "any\n#\npurpose")),
             (1001, "This program is free\nsoftware:"), (1002, L.SENTENCES["isc-grant"].replace("any purpose", "any. purpose"))]
    got = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, ids) in want.items():
        assert name in got[i]["licenses"].split(",") and got[i]["sentences"] == ids, (rows[i][1], got[i])
    assert [got[i]["sentences"] for i in (1000, 1001, 1002)] == ["", "gpl-free", ""]
