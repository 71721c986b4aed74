"""Reads by key and order, and the tables' updates: content, extraction, conversations, usage.

Tables are immutable snapshots; each update gives the next one. Appends are written as new files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.storage import scratch

TITLE, LIMIT = 200, 100


def document(docs: DataFrame, doc_id, site_id: str | None = None) -> DataFrame:
    """One document, gone ones too. The filter reaches the scan."""
    rows = docs if site_id is None else docs.where(F.col("site_id") == site_id)
    return rows.where(F.col("doc_id") == doc_id)


def chunks_of(chunks: DataFrame, doc_id) -> DataFrame:
    """A document's chunks in order."""
    return chunks.where(F.col("doc_id") == doc_id).orderBy("ordinal")


def sites(rows: DataFrame) -> DataFrame:
    return rows.orderBy("created_at", "site_id")


def conversations(rows: DataFrame, site_id, user_id, limit: int = LIMIT) -> DataFrame:
    """A user's conversations, the latest first."""
    own = rows.where((F.col("site_id") == site_id) & (F.col("user_id") == user_id))
    return own.orderBy(F.desc("updated_at"), F.desc("created_at"), "conversation_id").limit(limit)


def checkpoint(thread, checkpoints: DataFrame, blobs: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of a thread in the three tables of its state."""
    return tuple(t.where(F.col("thread") == thread) for t in (checkpoints, blobs, writes))


def with_blob(docs: DataFrame, blobs: DataFrame, live: bool = True) -> DataFrame:
    """Documents that refer to one of ``blobs`` (sha256)."""
    rows = docs.where("tombstoned_at IS NULL") if live and "tombstoned_at" in docs.columns else docs
    return rows.join(blobs.select(F.col("sha256").alias("blob_sha256")).distinct(), "blob_sha256", "left_semi")


def swap_content(stored: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """The next content table: documents in ``fresh`` have its rows alone, others keep theirs."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh.select(*stored.columns))


def replace_content(fresh: DataFrame, path: str, buckets: int = 256, key: str = "doc_id") -> None:
    """Swap the content of documents in a table partitioned by bucket, as one write.

    Only the buckets that have such documents are read and written; each is replaced as a whole, by
    dynamic partition overwrite, when all of the new files are there.
    """
    spark = fresh.sparkSession
    fresh = fresh.withColumn("bucket", bucket(F.col(key), buckets))
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    rows = swap_content(old, fresh, key).repartition("bucket")
    # Written elsewhere in full before the old files go.
    at = scratch(spark, "content")
    rows.write.parquet(at)
    spark.read.schema(rows.schema).parquet(at).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def bucket(key: Column, buckets: int = 256) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def delete_content(stored: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table without the rows (segments, chunks, vectors, postings) of ``ids``."""
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def to_rechunk(segments: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stored segments of the documents that ``changes`` (key, change; see ``sync.classify``) call relocated: their chunks get another header."""
    return segments.join(changes.where("change = 'relocated'").select(key), key, "left_semi")


def index_outcome(chunks: Column, needs_ocr: Column, ocr: Column, empty: str = "no-text") -> Column:
    """What follows chunking: "ocr" where pages need it and it is possible, else why there is no text (needs-ocr, or ``empty`` without chunks); null for none."""
    return F.when(needs_ocr & ocr, F.lit("ocr")).when(needs_ocr, F.lit("needs-ocr")).when(chunks == 0, F.lit(empty))


def record_extraction(docs: DataFrame, done: DataFrame, version: int) -> DataFrame:
    """The snapshot after extraction: ``done`` holds doc_id and skip_reason (null: extracted)."""
    new = done.select("doc_id", F.col("skip_reason").alias("new_reason"), F.lit(True).alias("done"))
    rows = docs.join(new, "doc_id", "left")
    return rows.withColumns({"extract_version": F.when(F.col("done"), F.lit(version)).otherwise(F.col("extract_version")), "skip_reason": F.when(F.col("done"), F.col("new_reason")).otherwise(F.col("skip_reason"))}).select(*docs.columns)


def reset_extraction(docs: DataFrame, only_skipped: bool = False) -> DataFrame:
    """The snapshot in which all documents, or the skipped ones, are to be extracted again."""
    hit = F.col("skip_reason").isNotNull() if only_skipped else F.lit(True)
    none = lambda c: F.when(~hit, F.col(c))
    return docs.withColumns({"extract_version": none("extract_version"), "skip_reason": none("skip_reason")})


def open_full_sync(runs: DataFrame, site_id, now: int, within: int = 86_400) -> bool:
    """Whether a full run of a site is open and was active within a day."""
    return not runs.where((F.col("site_id") == site_id) & (F.col("mode") == "full") & (F.col("state") == "open") & (F.col("last_activity") > now - within)).limit(1).isEmpty()


def append(rows: DataFrame, path: str) -> None:
    """New usage, events or checkpoints as new files of a table."""
    rows.write.mode("append").parquet(path)


def update_conversations(rows: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """Conversations after ``changes`` (conversation_id, title, archived; null: as it is): titles of at most 200 letters, new ones are created."""
    new = changes.select("conversation_id", F.substring(F.trim("title"), 1, TITLE).alias("new_title"), F.col("archived").alias("new_archived"), F.lit(True).alias("hit"))
    both = rows.join(new, "conversation_id", "full_outer")
    value = {"title": F.coalesce("new_title", "title"), "archived": F.coalesce("new_archived", "archived", F.lit(False)), "updated_at": F.when(F.col("hit"), F.lit(now)).otherwise(F.col("updated_at")), "created_at": F.coalesce("created_at", F.lit(now))}
    return both.select(*(value[c].alias(c) if c in value else F.col(c) for c in rows.columns))


def put_cache(cache: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """A cache (of vectors or OCR texts) after putting ``rows``, whose last row of a key, by ``at``, replaces what was there."""
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in cache.columns if c not in key)), "at").alias("v")).select(*key, "v.*")
    return cache.join(last.select(*key), key, "left_anti").unionByName(last.select(*cache.columns))


def ocr_split(images: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(images with the text the cache has for their bytes and model, images to read); the kind of file does not matter."""
    rows = images.withColumn("key", F.concat_ws(":", F.sha2("content", 256), F.lit(model)))
    known = cache.select("key", "text")
    return rows.join(known, "key"), rows.join(known.select("key"), "key", "left_anti")


def add_sites(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new sites; one that is there already is an error when it is read."""
    twice = new.join(registry.select("site_id", F.lit(True).alias("known")), "site_id", "left")
    fresh = twice.where(F.coalesce(F.assert_true(F.col("known").isNull(), "this site is registered").isNull(), F.lit(True))).drop("known")
    return registry.unionByName(fresh.select(*registry.columns))


def touch_sites(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """last_seen of sites after requests (site_id, ts)."""
    last = seen.groupBy("site_id").agg(F.max("ts").alias("ts"))
    return registry.join(last, "site_id", "left").withColumn("last_seen", F.greatest("last_seen", "ts")).select(*registry.columns)


#: What people call roles and kinds of documents.
ROLES = {"student": "Teilnehmer/in", "teacher": "Trainer/in ohne Bearbeitungsrecht", "editingteacher": "Trainer/in", "manager": "Manager/in", "coursecreator": "Kursersteller/in", "guest": "Gast"}
KINDS = {"inline": "Text", "html": "Seite", "file": "Datei", "external": "Link"}


def labelled(value: Column, labels: dict[str, str]) -> Column:
    """What people call a role or kind; itself where there is no label."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), value), value)
