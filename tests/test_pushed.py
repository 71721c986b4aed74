"""Requests and blobs as data sources."""

import hashlib
import json

import pytest

from lectern.sources import pushed


@pytest.fixture
def log(tmp_path):
    lines = [{"sync_id": f"s{i}", "documents": [{"doc_id": f"{i}-{k}", "kind": "inline", "text": "ä" * (i * 7 % 40), "timemodified": k} for k in range(i % 4)]} for i in range(60)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines) + "\n[{}]\n{\n17\n" + json.dumps([{"doc_id": "x", "kind": "html"}] * 6) + "\n")
    return tmp_path / "in"


def expected():
    return sorted([f"{i}-{k}" for i in range(60) for k in range(i % 4)])


@pytest.mark.parametrize("size", [1, 37, 1000, 1 << 20])
def test_ranges_of_any_size_give_each_document_once(spark, log, size):
    pushed.register(spark)
    docs, rejected = pushed.outputs(spark.read.format("lectern_requests").option("mostDocuments", 5).option("rangeBytes", max(size, 37)).load(f"file://{log}"))
    assert sorted(r["doc_id"] for r in docs.collect()) == expected()
    assert sorted(r["rejected"] for r in rejected.collect()) == ["at most 5 documents per request", "doc_id is missing", "no documents", "not JSON"]
    r = docs.where("doc_id = '7-2'").first()
    assert (r["sync_id"], r["text"], r["timemodified"], r["title"]) == ("s7", "ä" * 9, 2, None)


def test_a_stream_goes_on_after_a_restart_and_leaves_lines_being_written(spark, log, tmp_path):
    pushed.register(spark)
    whole = (log / "a.log").read_bytes()
    cut = whole.index(b"s30")
    (log / "a.log").write_bytes(whole[:cut])  # in the middle of a line

    def run():
        rows = spark.readStream.format("lectern_requests").option("mostDocuments", 5).option("rangeBytes", 200).load(f"file://{log}")
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/rows").where("rejected IS NULL").collect())

    assert run() == [d for d in expected() if int(d.split("-")[0]) < 30]
    (log / "a.log").write_bytes(whole)
    (log / "b.log").write_text(json.dumps([{"doc_id": "new", "kind": "html"}]) + "\n")
    assert run() == sorted([*expected(), "new"])
    assert run() == sorted([*expected(), "new"])


def digest(b):
    return hashlib.sha256(b).hexdigest()


def test_blobs_by_digest(spark, tmp_path):
    root = f"file://{tmp_path}/blobs"
    rows = [(digest(b"a"), b"a"), (digest(b"a"), b"a"), (digest(b"b"), b"c"), (digest(b"x" * 11), b"x" * 11), (digest(b""), None)]
    pushed.put_blobs(spark.createDataFrame(rows, "sha256 string, content binary"), root, 10)
    assert sorted((r["sha256"], r["bytes"]) for r in pushed.blob_sizes(spark, root).collect()) == [(digest(b"a"), 1)]
    said = {r["sha256"]: r["outcome"] for r in pushed.outcomes(spark, root).collect()}
    assert said == {digest(b"a"): "stored", digest(b""): "stored", digest(b"b"): "digest differs", digest(b"x" * 11): "too large"}
    assert not list((tmp_path / "blobs" / "_staging").glob("*"))
    pushed.put_blobs(spark.createDataFrame(rows[:1], "sha256 string, content binary"), root, 10)
    assert pushed.outcomes(spark, root).where("outcome = 'present'").count() == 1


def test_a_task_that_fails_leaves_nothing_to_see(spark, tmp_path):
    from pyspark.sql import functions as F

    pushed.register(spark)
    rows = spark.createDataFrame([(digest(bytes([i])), bytes([i]), i) for i in range(20)], "sha256 string, content binary, i int").coalesce(1)
    # The last row of the task raises, when all others are staged.
    bad = rows.select(F.when(F.col("i") == 19, F.raise_error("broken")).otherwise(F.col("sha256")).alias("sha256"), "content")
    with pytest.raises(Exception, match="broken"):
        bad.write.format("lectern_blobs").mode("append").save(f"file://{tmp_path}/blobs")
    assert not [p for p in (tmp_path / "blobs").rglob("*") if p.is_file() and "_staging" not in p.parts]


def test_blobs_are_listed_by_tasks(spark, tmp_path):
    """No reader of files, whose listing the driver holds; the empty blob is left out."""
    root = f"file://{tmp_path}/blobs"
    assert pushed.blob_sizes(spark, root).count() == 0
    contents = [b"", *(b"%d" % i for i in range(20))]
    pushed.put_blobs(spark.createDataFrame([(digest(c), c) for c in contents], "sha256 string, content binary"), root, 10)
    got = pushed.blob_sizes(spark, root)
    assert sorted(map(tuple, got.collect())) == sorted((digest(c), len(c)) for c in contents if c)
    assert not got.inputFiles()


def test_a_task_that_is_tried_again_says_what_the_job_stored(spark, tmp_path, monkeypatch):
    """The first attempt ends while it shows blobs, or when it is through; only what the committed one says counts."""
    root = f"file://{tmp_path}/blobs"
    rows = [{"sha256": digest(c), "content": c} for c in (b"a", b"b", b"c", b"d")]
    pushed.put_blobs(spark.createDataFrame([(digest(b"d"), b"d")], "sha256 string, content binary"), root)
    writer = pushed._Blobs({"path": root})
    made = []

    class Ends(pushed.pafs.SubTreeFileSystem):
        def move(self, src, dest):
            if made:
                raise OSError("the executor is lost")
            made.append(dest)
            super().move(src, dest)

    monkeypatch.setattr(writer, "_open", lambda: (Ends("/", pushed.pafs.LocalFileSystem()), f"{tmp_path}/blobs"))
    with pytest.raises(OSError, match="lost"):
        writer.write(iter(rows))
    monkeypatch.undo()
    assert len(made) == 1
    writer.write(iter(rows))
    writer.commit([writer.write(iter(rows))])
    said = sorted((r["sha256"], r["outcome"]) for r in pushed.outcomes(spark, root).collect())
    assert said == sorted([*((digest(c), "stored") for c in (b"a", b"b", b"c", b"d")), (digest(b"d"), "present")])
    assert not list((tmp_path / "blobs" / "_staging").glob("*"))


def test_other_contents_under_a_digest_do_not_keep_its_blob_out(spark, tmp_path):
    for i, contents in enumerate(((b"a", b"z"), (b"z", b"a"))):
        pushed.put_blobs(spark.createDataFrame([(digest(b"a"), c) for c in contents], "sha256 string, content binary").coalesce(1), root := f"file://{tmp_path}/{i}")
        assert sorted(r["outcome"] for r in pushed.outcomes(spark, root).collect()) == ["digest differs", "stored"]


def test_blobs_stored_of_odd_texts_as_its_sql(spark, tmp_path):
    """Empty and null texts, and one that is another's with the letter that makes its digest wrong."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    rows = [(11, "abc"), (1, "xabc"), (2, ""), (22, ""), (3, None), (33, None), (4, "ä" * 2500), (5, "ä" * 2501), (6, "abc"), (7, "abc")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries()["blobs_stored"](spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(oracle_sql()["blobs_stored"]).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
