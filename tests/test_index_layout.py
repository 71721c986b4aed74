"""How the inverted index is made."""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import indexing, live_index, search


def test_postings_are_grouped_without_a_shuffle_of_tokens(spark):
    rows = [(1, "b a b B"), (2, None), (3, ""), (4, "a"), (5, "ä a-c c " * 3000), (None, "a x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = search.posted(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    each = docs.select("doc_id", F.size(T.index_tokens("text")).alias("len"), F.posexplode(T.index_tokens("text")).alias("pos", "term")).groupBy("term", "doc_id", "len").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    want = each.withColumn("bucket", search.bucket(F.col("term")))
    as_rows = lambda df: sorted(map(str, df.select("term", "doc_id", "len", "positions", "bucket").collect()))
    assert as_rows(got) == as_rows(want) == as_rows(live_index.postings(docs))


def test_an_index_is_laid_out_by_one_shuffle(spark):
    plan = live_index.postings(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan


def test_a_commit_writes_postings_as_laid_out_and_joins_no_row_of_the_newest_layer(spark, tmp_path):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("wort"), F.col("id") % 7, F.lit(" aus")).alias("text"))
    first = live_index.create(live_index.open_store(spark, f"file://{tmp_path}/i"), docs)
    second = live_index.replace(first.store, docs.where("doc_id < 20"), docs.where("doc_id < 10").withColumn("text", F.lit("neu")))
    assert second.notes["n"] == 40 and second.notes["tokens"] == 10 + 30 * 2
    assert sorted(r["doc_id"] for r in live_index.bm25(second, "neu").collect()) == list(range(10))
    plan = second.table("postings")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.count("Join") == 1 and plan.index("Union") < plan.index("Join")


def test_lengths_by_segments_are_those_of_the_whole_text(spark):
    segments = spark.createDataFrame([(1, 0, "a b"), (1, 1, None), (1, 2, "c, d-e"), (2, 0, " ")], "doc_id long, ordinal int, text string")
    got = {r["doc_id"]: r["len"] for r in indexing._lengths(segments).collect()}
    assert got == {r["doc_id"]: r["len"] for r in live_index.lengths(indexing._texts(segments)).collect()} == {1: 5, 2: 0}
