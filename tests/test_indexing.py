"""The step after extraction."""

from lectern.operators import indexing, live_index


def test_what_becomes_of_a_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["K"], "html", None), (2, ["K"], "file", "image/png"), (3, [], "file", "text/plain"), (4, ["K"], "file", None), (5, ["K"], "html", None)], "doc_id long, header_path array<string>, kind string, mimetype string")
    segments = spark.createDataFrame([(1, 1, "zwei", 2, None, False), (1, 0, "eins", 1, None, None), (2, 0, " ", 1, None, False), (3, 0, "", 1, None, False), (4, 0, "seite", 1, None, True), (9, 0, "fremd", 1, None, False)], "doc_id long, ordinal int, text string, page int, label string, needs_ocr boolean")
    state = indexing.create(spark, f"file://{tmp_path}/content")
    state, outcome = indexing.index(state, docs, segments)
    assert sorted(tuple(r) for r in outcome.collect()) == [(1, 1, None, "embed"), (2, 0, None, "ocr"), (3, 0, "no-text", None), (4, 1, None, "ocr"), (5, 0, "no-text", None)]
    assert [(r["doc_id"], r["text"]) for r in state.table("chunks").orderBy("doc_id").collect()] == [(1, "K\n\neins\n\nzwei"), (4, "K\n\nseite")]
    assert [r["doc_id"] for r in live_index.bm25(state, "zwei").collect()] == [1] and not live_index.bm25(state, "fremd").collect()
    again, outcome = indexing.index(state, docs.where("doc_id IN (2, 4)"), segments.where("doc_id = 4"), ocr=False)
    assert sorted(tuple(r) for r in outcome.collect()) == [(2, 0, "needs-ocr", None), (4, 1, "needs-ocr", "embed")]
    moved = indexing.rechunk(again, docs.where("doc_id = 1").selectExpr("doc_id", "array('L') AS header_path"))
    assert [r["text"] for r in moved.table("chunks").where("doc_id = 1").collect()] == ["L\n\neins\n\nzwei"] and moved.table("segments").count() == again.table("segments").count()
