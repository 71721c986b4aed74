"""The job queue as snapshots: states queued, running, done, skipped, failed, waiting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.moments import backoff

KEY = ["site_id", "doc_id", "stage"]
ATTEMPTS = {"fetch": 6, "extract": 3, "ocr": 5}


def claim(jobs: DataFrame, stage: str, limit: int, now: int) -> DataFrame:
    """Due queued jobs by priority, time and id."""
    due = jobs.where((F.col("stage") == stage) & (F.col("state") == "queued") & (F.col("next_attempt_at") <= now))
    return due.orderBy("priority", "next_attempt_at", "id").limit(max(0, limit))


def mark_running(jobs: DataFrame, claimed: DataFrame, now: int) -> DataFrame:
    rows = jobs.join(F.broadcast(claimed.select("id").withColumn("mine", F.lit(True))), "id", "left")  # at most the claim's limit
    mine = F.col("mine").isNotNull()
    return rows.withColumns({"state": F.when(mine, "running").otherwise(F.col("state")), "started_at": F.when(mine, F.lit(now)).otherwise(F.col("started_at"))}).select(*jobs.columns)


def enqueue(jobs: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """The queue after asking for jobs (key, priority): queued ones keep the lower priority and their time, others start anew."""
    old = jobs.select(*KEY, F.col("id").alias("old_id"), *(F.col(c).alias(f"old_{c}") for c in jobs.columns if c not in KEY and c != "id"))
    rows = old.join(wanted.groupBy(*KEY).agg(F.min("priority").alias("priority")), KEY, "full_outer")
    asked, queued = F.col("priority").isNotNull(), F.coalesce(F.col("old_state") == "queued", F.lit(False))
    new = {
        "state": F.when(asked, F.lit("queued")).otherwise(F.col("old_state")),
        "priority": F.when(asked & queued, F.least("old_priority", "priority")).when(asked, F.col("priority")).otherwise(F.col("old_priority")),
        "attempts": F.when(asked, F.lit(0)).otherwise(F.col("old_attempts")),
        "next_attempt_at": F.when(asked, F.lit(now)).otherwise(F.col("old_next_attempt_at")),
        "enqueued_at": F.when(asked & ~queued, F.lit(now)).otherwise(F.col("old_enqueued_at")),
    }
    clear = {"last_error", "finished_at"}
    value = lambda c: new[c] if c in new else F.when(~asked, F.col(f"old_{c}")) if c in clear else F.col(f"old_{c}")
    return rows.select(F.col("old_id").alias("id"), *KEY, *(value(c).alias(c) for c in jobs.columns if c not in KEY and c != "id"))


def retry(jobs: DataFrame, failed: DataFrame, now: int, base: float = 30.0) -> DataFrame:
    """The queue after transient failures (id, error, at_least): another attempt later, or failed when attempts are used up."""
    rows = jobs.join(failed.select("id", F.col("error"), F.coalesce("at_least", F.lit(0.0)).alias("at_least")), "id", "left")
    hit, tries = F.col("error").isNotNull(), F.col("attempts") + 1
    most = F.coalesce(F.create_map(*(F.lit(x) for kv in ATTEMPTS.items() for x in kv))[F.col("stage")], F.lit(3))
    out = hit & (tries >= most)
    wait = backoff(F.col("attempts"), base, F.col("at_least")).cast("long")
    return rows.withColumns({"state": F.when(out, "failed").when(hit, "queued").otherwise(F.col("state")), "next_attempt_at": F.when(hit & ~out, F.lit(now) + wait).otherwise(F.col("next_attempt_at")), "finished_at": F.when(out, F.lit(now)).otherwise(F.col("finished_at")), "last_error": F.when(hit, F.col("error")).otherwise(F.col("last_error")), "attempts": F.when(hit, tries).otherwise(F.col("attempts"))}).select(*jobs.columns)


def outcome(df: DataFrame, error: str = "error") -> DataFrame:
    """What a stage's result means: done, retry (transient), skipped (permanent or no extractor), waiting (no blob yet)."""
    e = F.col(error)
    return df.withColumn("outcome", F.when(e.isNull(), "done").when(e == "transient", "retry").when(e == "missing-blob", "waiting").otherwise("skipped"))


def requeue_crashed(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("state", F.when(F.col("state") == "running", "queued").otherwise(F.col("state")))


def requeue_failed(jobs: DataFrame, now: int, after: int = 6 * 3600) -> DataFrame:
    """Failed fetches are tried again after six hours."""
    old = (F.col("stage") == "fetch") & (F.col("state") == "failed") & (F.col("finished_at") <= now - after)
    return jobs.withColumns({"state": F.when(old, "queued").otherwise(F.col("state")), "attempts": F.when(old, 0).otherwise(F.col("attempts")), "next_attempt_at": F.when(old, F.lit(now)).otherwise(F.col("next_attempt_at"))})


def counts(jobs: DataFrame, now: int) -> DataFrame:
    """Per stage and state the number of jobs, and the age of the oldest queued one."""
    got = jobs.groupBy("stage", "state").agg(F.count("*").alias("n"), F.min("enqueued_at").alias("oldest"))
    return got.select("stage", "state", "n", F.when(F.col("state") == "queued", F.lit(now) - F.col("oldest")).alias("age"))


def ingest_status(docs: DataFrame) -> DataFrame:
    """One row: live documents, those not extracted yet (pending), those without text (skipped), and courses."""
    rows = docs.where("tombstoned_at IS NULL") if "tombstoned_at" in docs.columns else docs
    return rows.agg(F.count("*").alias("documents"), F.count_if(F.col("extract_version").isNull()).alias("pending"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"), F.count_distinct("course_id").alias("courses"))


def site_status(docs: DataFrame, courses: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Per site: courses and documents that are live, of these pending and skipped ones, chunks of live documents, and the last sync run (struct, null for none).

    Each table is counted by site before they meet; a site that only runs or courses know is there too.
    """
    live = docs.where("tombstoned_at IS NULL")
    n = live.groupBy("site_id").agg(F.count("*").alias("documents"), F.count_if(F.col("extract_version").isNull()).alias("pending"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"))
    c = courses.where("tombstoned_at IS NULL").groupBy("site_id").agg(F.count("*").alias("courses"))
    k = chunks.join(live.select("site_id", "doc_id"), ["site_id", "doc_id"], "left_semi").groupBy("site_id").agg(F.count("*").alias("chunks"))
    r = runs.groupBy("site_id").agg(F.max(F.struct("started_at", "sync_id", "mode", "state", "finished_at")).alias("last_sync"))
    every = n.join(c, "site_id", "full_outer").join(k, "site_id", "full_outer").join(r, "site_id", "full_outer")
    return every.select("site_id", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("courses", "documents", "pending", "skipped", "chunks")), "last_sync")


def failed_live(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Failed jobs whose document is live."""
    return jobs.where("state = 'failed'").join(docs.where("tombstoned_at IS NULL"), ["site_id", "doc_id"], "left_semi")


def next_due(jobs: DataFrame) -> DataFrame:
    return jobs.where("state = 'queued'").agg(F.min("next_attempt_at").alias("next_due"))


def waiting_for_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id", poisoned: DataFrame | None = None) -> DataFrame:
    """Chunks without a vector, but for those that failed too often."""
    rows = chunks.join(vectors.select(key), key, "left_anti")
    return rows if poisoned is None else rows.join(poisoned.select(key), key, "left_anti")
