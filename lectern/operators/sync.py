"""Snapshots of documents and what changes them: upserts, manifests, tombstones, orphans.

A snapshot is immutable; every write is a full-outer join or a filter that gives the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["site_id", "doc_id"]
PLACEMENT = ["section_id", "section_order", "section_name", "module_name", "title", "header_path"]


def content_hash(c: Column | str) -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def placement_hash(*cols: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def classify(stored: DataFrame, pushed: DataFrame, key: list[str] | None = None, placement: list[str] | None = None) -> DataFrame:
    """For each pushed document what it is: changed (extract again), relocated (chunk again), moved or same."""
    key, placement = key or KEY, placement or [c for c in PLACEMENT if c in pushed.columns]
    old = stored.select(*key, F.col("content_hash").alias("old_hash"), F.col("tombstoned_at").alias("gone"), F.lit(True).alias("known"), *(F.col(c).alias(f"old_{c}") for c in placement))
    rows = pushed.join(old, key, "left")
    same = F.col("known") & F.col("gone").isNull() & (F.col("old_hash") == F.col("content_hash"))
    differs = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(c))
    moved = F.lit(False)
    for c in placement:
        moved = moved | differs(c)
    relocated = differs("header_path") if "header_path" in placement else F.lit(False)
    return rows.select(*key, F.when(~F.coalesce(same, F.lit(False)), "changed").when(relocated, "relocated").when(moved, "moved").otherwise("same").alias("change"))


def upsert(stored: DataFrame, pushed: DataFrame, key: list[str], stamp: int, keep: tuple[str, ...] = ("sync_id", "placement_hash"), reset: tuple[str, ...] = ("extract_version", "skip_reason")) -> DataFrame:
    """The next snapshot: pushed rows win and are live; ``keep`` columns stay where the push has null; ``reset`` ones go unless the content is the same."""
    old = stored.select(*key, *(F.col(c).alias(f"old_{c}") for c in stored.columns if c not in key), F.lit(True).alias("was"))
    rows = old.join(pushed.withColumn("now", F.lit(True)), key, "full_outer")
    new, same = F.col("now").isNotNull(), F.lit(False)
    if "content_hash" in pushed.columns:
        same = F.col("was").isNotNull() & F.col("old_tombstoned_at").isNull() & (F.col("old_content_hash") == F.col("content_hash"))
    out = []
    for c in stored.columns:
        old_c = F.col(f"old_{c}")
        if c in key:
            out.append(F.col(c))
        elif c == "tombstoned_at":
            out.append(F.when(~new, old_c).alias(c))
        elif c == "last_seen":
            out.append(F.when(new, F.lit(stamp)).otherwise(old_c).alias(c))
        elif c in reset:
            out.append(F.when(~new | F.coalesce(same, F.lit(False)), old_c).alias(c))
        elif c not in pushed.columns:
            out.append(old_c.alias(c))
        else:
            out.append(F.when(new, F.coalesce(F.col(c), old_c) if c in keep else F.col(c)).otherwise(old_c).alias(c))
    return rows.select(*out)


def need(stored: DataFrame, manifest: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Keys of a manifest whose documents must be sent: missing, gone, other content, or another given placement."""
    key = key or KEY
    old = stored.select(*key, F.col("content_hash").alias("h"), F.col("placement_hash").alias("p"), F.col("tombstoned_at").alias("gone"), F.lit(True).alias("known"))
    rows = manifest.join(old, key, "left")
    other = F.col("placement_hash").isNotNull() & ~F.col("placement_hash").eqNullSafe(F.col("p"))
    return rows.where(F.col("known").isNull() | F.col("gone").isNotNull() | (F.col("h") != F.col("content_hash")) | other).select(*key)


def stamp_seen(stored: DataFrame, manifest: DataFrame, sync_id: str, seq: int, key: list[str] | None = None) -> DataFrame:
    """Listed live documents are seen in this run, whether they must be sent or not."""
    key = key or KEY
    rows = stored.join(manifest.select(*key).distinct().withColumn("listed", F.lit(True)), key, "left")
    seen = F.col("listed").isNotNull() & F.col("tombstoned_at").isNull()
    return rows.withColumns({"sync_id": F.when(seen, F.lit(sync_id)).otherwise(F.col("sync_id")), "seen_seq": F.when(seen, F.lit(seq)).otherwise(F.col("seen_seq"))}).select(*stored.columns)


def finish(stored: DataFrame, sync_id: str, start_seq: int, now: int, mode: str = "full", state: str = "open", last_activity: int | None = None) -> DataFrame:
    """The snapshot after a run ends: a full one tombstones what it neither listed nor was pushed during it.

    A finished run changes nothing; one idle for a day is an error and deletes nothing.
    """
    if state == "finished" or mode != "full":
        return stored
    if last_activity is not None and now - last_activity > 86_400:
        raise RuntimeError("this run is stale")
    gone = F.col("tombstoned_at").isNull() & (F.col("seen_seq") < start_seq) & ~F.col("sync_id").eqNullSafe(F.lit(sync_id))
    return stored.withColumn("tombstoned_at", F.when(gone, F.lit(now)).otherwise(F.col("tombstoned_at")))


def tombstone(stored: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Marks ids as gone; one that ends in * stands for all that begin like it (a course or module)."""
    exact = ids.where(~F.col("doc_id").endswith("*"))
    prefix = ids.where(F.col("doc_id").endswith("*")).select(F.regexp_replace("doc_id", r"\*$", "").alias("prefix"))
    # Prefixes are course or course:module, so both joins are by equality.
    course, module = F.concat(F.substring_index("doc_id", ":", 1), F.lit(":")), F.concat(F.substring_index("doc_id", ":", 2), F.lit(":"))
    hit = exact.select("doc_id").distinct().withColumn("hit", F.lit(True))
    p = prefix.distinct().withColumn("hit_prefix", F.lit(True))
    rows = stored.withColumns({"by_course": course, "by_module": module}).join(hit, "doc_id", "left")
    rows = rows.join(p.select(F.col("prefix").alias("by_course"), F.col("hit_prefix").alias("hc")), "by_course", "left").join(p.select(F.col("prefix").alias("by_module"), F.col("hit_prefix").alias("hm")), "by_module", "left")
    gone = F.coalesce("hit", "hc", "hm").isNotNull() & F.col("tombstoned_at").isNull()
    return rows.withColumn("tombstoned_at", F.when(gone, F.lit(now)).otherwise(F.col("tombstoned_at"))).select(*stored.columns)


def orphan_blobs(blobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Blobs that no live document refers to."""
    used = docs.where("tombstoned_at IS NULL AND blob_sha256 IS NOT NULL").select(F.col("blob_sha256").alias("sha256"))
    return blobs.join(used, "sha256", "left_anti")


def missing_blobs(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """Distinct sha256 of (sha256, pos) that are not stored, in the order asked."""
    return wanted.groupBy("sha256").agg(F.min("pos").alias("pos")).join(blobs, "sha256", "left_anti").orderBy("pos")


def verified_blobs(files: DataFrame, most: int = 25 << 20) -> DataFrame:
    """Of binary files (content, name: the hex digest) what is stored, and why the others are not."""
    digest = F.sha2("content", 256)
    return files.select("name", digest.alias("sha256"), F.length("content").alias("size"), F.when(F.length("content") > most, "too-large").when(digest != F.col("name"), "digest-mismatch").alias("refused"))


def keep_latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rn = 1").drop("rn")


def prune_checkpoints(checkpoints: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The latest checkpoint per thread and namespace, and the blobs (thread, ns, channel, version) it refers to."""
    latest = keep_latest(checkpoints, ["thread", "ns"], F.desc("checkpoint_id"))
    refs = latest.select("thread", "ns", F.explode("versions").alias("channel", "version"))
    return latest, blobs.join(refs, ["thread", "ns", "channel", "version"], "left_semi")


def collapse_outbox(changes: DataFrame) -> DataFrame:
    """The last change per course and module; a deleted course drops the earlier ones of its modules."""
    gone = changes.where("action = 'course_deleted'").groupBy("course_id").agg(F.max("id").alias("gone"))
    left = changes.join(gone, "course_id", "left").where((F.col("action") == "course_deleted") | F.col("gone").isNull() | (F.col("id") > F.col("gone"))).drop("gone")
    return keep_latest(left, ["course_id", "cmid"], F.desc("id"))


def needing_extraction(docs: DataFrame, version: int, limit: int) -> DataFrame:
    return docs.where((F.col("extract_version").isNull() | (F.col("extract_version") < version)) & F.col("tombstoned_at").isNull()).orderBy("last_seen", "doc_id").limit(limit)


def manifest_errors(rows: DataFrame, required: list[str], key: str, refs: tuple[str, DataFrame, str] | None = None) -> DataFrame:
    """Problems of a manifest as rows (error, item): missing values, repeated keys, unknown references."""
    found = None
    for c in required:
        bad = rows.where(F.col(c).isNull()).select(F.lit(f"missing {c}").alias("error"), F.col(key).cast("string").alias("item"))
        found = bad if found is None else found.unionAll(bad)
    twice = rows.groupBy(key).count().where("count > 1").select(F.lit(f"repeated {key}").alias("error"), F.col(key).cast("string").alias("item"))
    found = twice if found is None else found.unionAll(twice)
    if refs:
        column, other, their = refs
        lost = rows.join(other.select(F.col(their).alias(column)), column, "left_anti").select(F.lit(f"unknown {column}").alias("error"), F.col(column).cast("string").alias("item"))
        found = found.unionAll(lost)
    return found
