"""The stages of the pipeline, each against its own brute force on its own input."""

import corpus_pipeline
from test_training_data import brute_components, brute_lines, documents, odd

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_chain(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SMALL)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == COLUMNS and set(after) <= set(before), name
        if name == "line_dedup":
            ids = sorted(before)
            assert {i: after[i].text for i in ids} == dict(zip(ids, brute_lines([before[i].text for i in ids]).values(), strict=True))
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id].text)
        if name == "minhash_near_dedup":
            groups = brute_components([(i, r.text) for i, r in before.items()], 80)
            assert set(after) == {i for i, (_, _, kept) in groups.items() if kept}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == docs.count() and last.where("not exact").count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "exact"] and 0 < rows.count() <= 200


def test_stages_on_odd_input(spark):
    for docs in (odd(spark), documents(spark, [])):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == ["doc_id", "text", "fp", "n"]
        assert docs.count() <= n and docs.where("doc_id is null").count() == min(n, 1)


def test_line_dedup_leaves_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "one line of words\nmine " + str(i), 7, 8, 9, 1, 2) for i in range(3)], "doc_id long, text string, n_lines int, n_dropped int, _id int, _gone int, n_chars int")
    left = corpus_pipeline.line_dedup(spark, docs, SMALL).orderBy("doc_id").collect()
    assert [tuple(r) for r in left] == [(0, "one line of words\nmine 0", 7, 8, 9, 1, 2), (1, "mine 1", 7, 8, 9, 1, 6), (2, "mine 2", 7, 8, 9, 1, 6)]


def test_waiting_workers_hold_little(spark):
    """A stage's tasks drop what another stage left in their worker, and documents come in small batches."""
    from paperloom.llm import common

    assert common.remembered("codec", lambda: [1]) is common.remembered("codec", lambda: [2])
    assert list(common.lean(iter, remembers=True)([3, 4])) == [3, 4] and common._REMEMBERED == {"codec": [1]}
    assert list(common.lean(iter)([3, 4])) == [3, 4] and common._REMEMBERED == {}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        corpus_pipeline._start(spark)
        assert int(spark.conf.get(name)) == corpus_pipeline.BATCH_ROWS
    finally:
        spark.conf.set(name, before)
