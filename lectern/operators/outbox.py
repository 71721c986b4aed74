"""A producer's outbox: changes (id, course_id, cmid, attempts, next_attempt_at) waiting to be sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DUE, SHOWN, MOST_ATTEMPTS = 200, 50, 12


def due(outbox: DataFrame, now: int, limit: int = DUE) -> DataFrame:
    """What is to be sent now, by course and module; rows without attempts left are not."""
    return outbox.where((F.col("next_attempt_at") <= now) & (F.col("attempts") < MOST_ATTEMPTS)).orderBy("course_id", "cmid", "id").limit(limit)


def failing(outbox: DataFrame, limit: int = SHOWN) -> DataFrame:
    """Rows that failed, those with most attempts first."""
    return outbox.where("attempts > 0").orderBy(F.desc("attempts"), "course_id", "cmid", "id").limit(limit)


def counts(outbox: DataFrame) -> DataFrame:
    """One row: pending (all that can still be sent), failing (of these, tried before), exhausted."""
    out = F.col("attempts") >= MOST_ATTEMPTS
    return outbox.agg(F.count_if(~out).alias("pending"), F.count_if(~out & (F.col("attempts") > 0)).alias("failing"), F.count_if(out).alias("exhausted"))


def retry_exhausted(outbox: DataFrame, now: int) -> DataFrame:
    """The outbox in which rows without attempts left start anew."""
    out = F.col("attempts") >= MOST_ATTEMPTS
    return outbox.withColumns({"next_attempt_at": F.when(out, F.lit(now)).otherwise(F.col("next_attempt_at")), "attempts": F.when(out, F.lit(0)).otherwise(F.col("attempts"))})


def cleared(outbox: DataFrame, courses: DataFrame | None = None) -> DataFrame:
    """The outbox without the rows of some courses, or empty."""
    return outbox.where(F.lit(False)) if courses is None else outbox.join(courses.select("course_id").distinct(), "course_id", "left_anti")
