"""What a reader may see. Every filter here goes below ranking and limits, never above."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _allowed(df: DataFrame, column: str, ids: Iterable | DataFrame | None) -> DataFrame:
    """Rows whose column is among ``ids``; None: all rows; no ids: no rows."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias("allowed_id")), F.col(column) == F.col("allowed_id"), "left_semi")
    ids = list(ids)
    return df.where(F.col(column).isin(ids)) if ids else df.where(F.lit(False))


def live(df: DataFrame) -> DataFrame:
    return df.where("tombstoned_at IS NULL") if "tombstoned_at" in df.columns else df


def in_scope(docs: DataFrame, *, site_id: str | None = None, cmids=None, doc_ids=None, since: int | None = None, until: int | None = None, modified: str = "timemodified") -> DataFrame:
    """Live documents of a site, of allowed modules and ids, modified within inclusive bounds."""
    docs = live(docs if site_id is None else docs.where(F.col("site_id") == site_id))
    docs = _allowed(_allowed(docs, "cmid", cmids), "doc_id", doc_ids)
    if since is not None:
        docs = docs.where(F.col(modified) >= since)
    return docs if until is None else docs.where(F.col(modified) <= until)


def readable(docs: DataFrame, acl: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """The second, fresher check; without a list of permissions it fails, never allows."""
    if acl is None:
        raise PermissionError("no permissions to check against")
    return docs.join(acl.select(key), key, "left_semi")


def permitted(required: Column, held: Column) -> Column:
    """Whether all required capabilities are held."""
    return F.size(F.array_except(required, held)) == 0


def course_included(df: DataFrame, allowlist: Iterable[int]) -> DataFrame:
    """An empty allowlist includes every course."""
    ids = list(allowlist)
    return df.where(F.col("course_id").isin(ids)) if ids else df


def build_scope(enrolled: DataFrame, modules: DataFrame, included: DataFrame | None = None) -> DataFrame:
    """For each user the sorted distinct module ids and roles of included courses with visible modules."""
    rows = enrolled if included is None else enrolled.join(included.select("course_id"), "course_id", "left_semi")
    rows = rows.join(modules.where("visible").select("course_id", "cmid"), "course_id")
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_set("cmid")).alias("cmids"), F.array_sort(F.collect_set("role")).alias("roles"))


def under(df: DataFrame, prefix: str | None, path: str = "path") -> DataFrame:
    """Rows at or below a path; None, empty and / mean all."""
    at = (prefix or "").rstrip("/")
    return df if not at else df.where((F.col(path) == at) | F.col(path).startswith(at + "/"))
