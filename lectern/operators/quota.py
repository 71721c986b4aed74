"""Token use and its limits in calendar windows of a time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.moments import window_end, window_start

CHAT, INGEST = ("chat", "utility"), ("embed", "ocr")


def tokens(count_reasoning: bool = True) -> Column:
    """Input and output, less reasoning where that does not count."""
    all_ = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return all_ if count_reasoning else all_ - F.coalesce("reasoning_tokens", F.lit(0))


def in_window(usage: DataFrame, since: Column | int, until: Column | int, purposes: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of a half-open window."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = usage.where((F.col("ts") >= lit(since)) & (F.col("ts") < lit(until)))
    return rows if purposes is None else rows.where(F.col("purpose").isin(*purposes))


def used(usage: DataFrame, now: int, zone: str, unit: str, purposes: tuple[str, ...] = CHAT, by: tuple[str, ...] = ("site_id", "user_id"), count_reasoning: bool = True) -> DataFrame:
    """Tokens in the day or month around ``now``; rows later in the same window count too."""
    at = F.lit(now)
    rows = in_window(usage, window_start(at, unit, zone), window_end(at, unit, zone), purposes)
    return rows.groupBy(*by).agg(F.sum(tokens(count_reasoning)).alias("used"))


def report(usage: DataFrame, by_user: bool = True, count_reasoning: bool = True) -> DataFrame:
    """Tokens and calls per user, most first; or one row for all, none without use."""
    if by_user:
        return usage.groupBy("user_id").agg(F.sum(tokens(count_reasoning)).alias("tokens"), F.count("*").alias("calls")).orderBy(F.desc("tokens"), "user_id")
    return usage.agg(F.sum(tokens(count_reasoning)).alias("tokens"), F.count("*").alias("calls")).where("calls > 0")


def report_all(usage: DataFrame) -> DataFrame:
    """Both grains at once; user_id is null in the total."""
    return usage.rollup("user_id").agg(F.sum(tokens()).alias("tokens"), F.count("*").alias("calls"))


def status(usage: DataFrame, now: int, zone: str, day_limit: Column, month_limit: Column, purposes: tuple[str, ...] = CHAT, by: tuple[str, ...] = ("site_id", "user_id"), count_reasoning: bool = True) -> DataFrame:
    """Per user what is used of day and month, the limits, and when each starts anew: one scan, bounded by the month."""
    at = F.lit(now)
    day, month, end = window_start(at, "day", zone), window_start(at, "month", zone), window_end(at, "month", zone)
    rows = in_window(usage, F.least(day, month), end, purposes)
    today = (F.col("ts") >= day) & (F.col("ts") < window_end(at, "day", zone))
    n = tokens(count_reasoning)
    got = rows.groupBy(*by).agg(F.coalesce(F.sum(F.when(today, n)), F.lit(0)).alias("day_used"), F.sum(n).alias("month_used"))
    return got.withColumns({"day_limit": day_limit, "month_limit": month_limit, "day_resets_at": window_end(at, "day", zone), "month_resets_at": end})


def smaller(*limits: Column) -> Column:
    """The smallest limit there is; null is none."""
    return F.least(*limits)


def violated(df: DataFrame, headroom: int) -> DataFrame:
    """df (user_day, user_month, site_day, site_month and their limits _limit) with the first limit that is exceeded."""
    out = F.coalesce(*(F.when(F.coalesce(F.col(w), F.lit(0)) + headroom > F.col(f"{w}_limit"), F.lit(w)) for w in ("user_day", "user_month", "site_day", "site_month")))
    return df.withColumn("violated", out)


def exhausted(turn_tokens: Column, cap: Column, violated_window: Column) -> Column:
    """Whether a turn must stop: its own cap (60000 unless told) or any window."""
    return (turn_tokens > F.coalesce(cap, F.lit(60_000))) | violated_window.isNotNull()


def gate(use_today: Column, ceiling: Column) -> Column:
    """Whether ingestion may go on; no ceiling: yes."""
    return F.coalesce(F.coalesce(use_today, F.lit(0)) < ceiling, F.lit(True))


def user_limit(override: Column, site: Column, known: Column) -> Column:
    """An override of null inherits, of 0 is no limit; the site's 0 is no limit."""
    return F.when(known & override.isNotNull(), F.nullif(override, F.lit(0))).otherwise(F.nullif(site, F.lit(0)))


def user_limits(users: DataFrame, sites: DataFrame, overrides: DataFrame) -> DataFrame:
    """users (site_id, user_id) with day_limit and month_limit: their override's, where there is one, else their site's; null is no limit."""
    own = overrides.select("site_id", "user_id", F.col("day_limit").alias("own_day"), F.col("month_limit").alias("own_month"), F.lit(True).alias("known"))
    site = sites.select("site_id", F.col("day_limit").alias("site_day"), F.col("month_limit").alias("site_month"))
    rows = users.join(site, "site_id", "left").join(own, ["site_id", "user_id"], "left")
    known = F.coalesce("known", F.lit(False))
    return rows.select(*users.columns, *(user_limit(F.col(f"own_{w}"), F.col(f"site_{w}"), known).alias(f"{w}_limit") for w in ("day", "month")))
