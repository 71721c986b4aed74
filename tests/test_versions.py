"""Versions of several tables, and the index that follows them."""

import pytest

from lectern.operators import live_index, search
from lectern.operators.versions import Conflict, Store


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, f"alpha {'beta ' * (i % 4)}doc{i}") for i in range(20)], "doc_id long, text string")


def rows(snapshot, name="chunks"):
    return sorted((r["doc_id"], r["text"]) for r in snapshot.table(name).collect())


@pytest.fixture
def store(spark, tmp_path, docs):
    s = Store(spark, f"file://{tmp_path}/store")
    s.create({"chunks": docs, "titles": docs.select("doc_id", docs.text.substr(1, 5).alias("title"))})
    return s


def test_a_commit_changes_all_tables_and_readers_keep_theirs(spark, store, docs):
    old = store.snapshot()
    new = docs.where("doc_id < 3").selectExpr("doc_id", "'new' AS text")
    now = store.replace(docs.where("doc_id < 5"), {"chunks": new})
    assert now.version == 1 and store.versions() == [0, 1]
    assert rows(old) == rows(store.snapshot(0)) and len(rows(old)) == 20
    assert [t for _, t in rows(now)[:3]] == ["new"] * 3 and len(rows(now)) == 18
    assert now.table("titles").count() == 15
    # Again the same documents: the last layer has them.
    assert rows(store.replace(new, {"chunks": new.selectExpr("doc_id", "'newer' AS text")}))[0] == (0, "newer")


def test_rows_of_untouched_documents_are_not_taken(store, docs):
    assert len(rows(store.replace(docs.where("doc_id = 1"), {"chunks": docs}))) == 20
    with pytest.raises(ValueError, match="no table"):
        store.replace(docs, {"other": docs})


def test_of_two_writers_one_loses_and_leaves_nothing(store, docs):
    base = store.snapshot()
    won = store.delete(docs.where("doc_id = 1"), base)
    layers = [n for n, _ in store._names(store.path)]
    with pytest.raises(Conflict):
        store.delete(docs.where("doc_id = 2"), base)
    assert [n for n, _ in store._names(store.path)] == layers and not [n for n, _ in store._names(f"{store.path}/_log") if not n.endswith((".json", ".crc"))]
    assert rows(store.snapshot()) == rows(won) and len(rows(won)) == 19


def test_a_writer_that_dies_leaves_the_old_state(store, docs, monkeypatch):
    def dies(*_):
        raise SystemExit  # not an error that the writer could clean up after

    monkeypatch.setattr(store, "_publish", dies)
    with pytest.raises(SystemExit):
        store.replace(docs.where("doc_id = 1"), {"chunks": docs})
    monkeypatch.undo()
    assert store.versions() == [0] and len(rows(store.snapshot())) == 20
    assert store.clean() == []  # its files may be those of a writer at work
    assert len(store.clean(idle=-60)) == 1 and len(rows(store.snapshot())) == 20
    assert len(rows(store.delete(docs.where("doc_id = 1")))) == 19


def test_compaction_and_cleaning(store, docs):
    store.delete(docs.where("doc_id % 2 = 0"))
    before = store.snapshot()
    after = store.compact()
    assert len(after.layers) == 1 and rows(after) == rows(before)
    assert len(store.clean(keep=1, idle=-60)) == 2
    assert store.versions() == [2] and rows(store.snapshot()) == rows(after)
    with pytest.raises(LookupError):
        store.snapshot(0)


def test_null_ids_and_empty_stores(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/empty")
    with pytest.raises(LookupError):
        s.snapshot()
    none = spark.createDataFrame([], "doc_id long, text string")
    s.create({"chunks": none})
    some = spark.createDataFrame([(1, "a"), (None, "b")], "doc_id long, text string")
    assert rows(s.replace(some, {"chunks": some})) == [(1, "a")]


def scores(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("mode", ["any", "all", "phrase"])
def test_an_index_after_changes_scores_like_a_new_one(spark, tmp_path, docs, mode):
    index = live_index.create(live_index.open_store(spark, f"file://{tmp_path}/index"), docs)
    fresh = docs.where("doc_id IN (2, 3)").selectExpr("doc_id", "'beta alpha beta' AS text").unionByName(spark.createDataFrame([(77, "alpha beta")], "doc_id long, text string"))
    index = live_index.replace(index.store, fresh, fresh)
    index = live_index.replace(index.store, docs.where("doc_id > 15"), docs.limit(0), base=index)
    now = docs.where("doc_id NOT IN (2, 3) AND doc_id <= 15").unionByName(fresh)
    plain = scores(search.bm25(now, "beta alpha", mode))
    assert plain and scores(live_index.bm25(index, "beta alpha", mode)) == plain
    assert scores(live_index.bm25(live_index.compact(index.store), "beta alpha", mode)) == plain
    assert index.notes["n"] == now.count()


def test_searches_by_an_index_read_its_parts_alone(spark, tmp_path, docs):
    index = live_index.create(live_index.open_store(spark, f"file://{tmp_path}/index"), docs)
    index = live_index.replace(index.store, docs.where("doc_id = 1"), docs.where("doc_id = 1"))
    hits = search.hybrid(docs, None, "beta", None, index=live_index.ranking(index))
    plan = hits._jdf.queryExecution().toString()
    scans = [x for x in plan[plan.index("Physical Plan") :].split("\n") if "FileScan" in x and "positions" in x]
    assert scans and all("PartitionFilters: [isnotnull(bucket" in x for x in scans), plan
    assert not [x for x in plan.split("\n") if "FileScan" in x and ",text#" in x]
    assert scores(hits) == scores(search.hybrid(docs, None, "beta", None))
    assert [tuple(r) for r in search.text_search(docs, "beta", index=live_index.ranking(index)).collect()] == [tuple(r) for r in search.text_search(docs, "beta").collect()]
    assert live_index.bm25(index, "...").collect() == []


def test_days_follow_the_clock(spark, tmp_path):
    """Hours over the end of summer time in Berlin: that day has 25, those beside it 24."""
    from pyspark.sql import functions as F

    from lectern.streaming import usage

    hours = spark.range(24 * 5).select(F.timestamp_seconds(F.lit(1729720800) + F.col("id") * 3600).alias("ts"), F.lit(1).alias("user_id"), F.lit(1).alias("tokens"))
    hours.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(hours.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {str(r["day"]): r["tokens"] for r in usage.run_available(usage.daily_usage(stream, "Europe/Berlin", "10 days"), f"file://{tmp_path}/out", ["day", "user_id"]).collect()}
    assert got == {"2024-10-24": 24, "2024-10-25": 24, "2024-10-26": 24, "2024-10-27": 25, "2024-10-28": 23}
