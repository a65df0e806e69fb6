import corpus_pipeline
import __spark_entry__ as entry
from indicata.llm import language_id, pii
from indicata.llm.common import table
from test_packing import brute_pieces
from test_simhash import brute_components, brute_fingerprint


def brute_pipeline(docs):
    """The stages over a list of row dicts, with the learned models of each stage's own input."""
    spark = docs.sparkSession
    model = language_id.train(docs)
    rows = [r.asDict() for r in docs.collect()]
    labels, score = language_id.score_texts(model, [r["text"] for r in rows])
    rows = [r for r, lab, s in zip(rows, labels, score) if lab != "und" and s >= 0.5]
    rows.sort(key=lambda r: r["doc_id"])
    comp = brute_components([brute_fingerprint(r["text"]) for r in rows])
    rows = [r for i, r in enumerate(rows) if comp[i] == i]
    kept = spark.createDataFrame(rows, docs.schema)
    spans = pii.train(kept)
    return brute_pieces([(r["doc_id"], pii.masked(r["text"], pii.spans(r["text"], spans)[1])) for r in rows])


def test_run_equals_the_brute_force_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    want = brute_pipeline(table(spark, "/root/testdata/sf0.001", "documents"))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == want


def test_stages_keep_the_columns_and_survive_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "")
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
        corpus_pipeline.STAGES[-1][1](spark, now, "").collect()


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert "op2_license_scan" in entry.oracle_sql()
