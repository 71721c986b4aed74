"""Building a dataset's manifest from documents, and what a producer sends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File types that are sent unless others are told, and the largest size in MB.
FILE_TYPES = "pdf,doc,docx,odt,rtf,txt,md,csv,html,htm,ppt,pptx,odp,xls,xlsx,ods,epub,json,xml"
MOST_MB = 25


def allowed(name: Column, size: Column, types: str = FILE_TYPES, most_mb: int = MOST_MB) -> Column:
    """Whether a file's extension and size are among those that are sent."""
    known = [t.strip().lower().lstrip(".") for t in types.replace(";", ",").replace(" ", ",").split(",") if t.strip()]
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(known) & (size <= most_mb * 1024 * 1024)


def skipped(docs: DataFrame, blobs: DataFrame, courses: list[int] | None = None, most_mb: float = 0) -> DataFrame:
    """Documents of the chosen courses with reason: no blob, blob missing or too large; null for those that are taken."""
    rows = docs.where(F.col("course_id").isin(courses)) if courses else docs
    rows = rows.join(blobs.select(F.col("sha256").alias("blob_sha256"), F.col("size").alias("blob_size")), "blob_sha256", "left")
    large = (F.col("kind") == "file") & (F.col("blob_size") > most_mb * 1_000_000) if most_mb else F.lit(False)
    return rows.withColumn("reason", F.when(F.coalesce("blob_sha256", F.lit("")) == "", "no blob").when(F.col("blob_size").isNull(), "blob missing").when(large, "too large"))


def manifest(docs: DataFrame, order: str) -> DataFrame:
    """course_id and sections: array of struct(name, modules: array of struct(id, documents)), each in the order in which it is first seen."""
    modules = docs.groupBy("course_id", F.coalesce("section_name", F.lit("")).alias("section"), "module_id").agg(F.min(order).alias("seen"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "doc_id"))), lambda d: d["doc_id"]).alias("documents"))
    sections = modules.groupBy("course_id", "section").agg(F.min("seen").alias("seen"), F.transform(F.array_sort(F.collect_list(F.struct("seen", "module_id", "documents"))), lambda m: F.struct(m["module_id"].alias("id"), m["documents"])).alias("modules"))
    return sections.groupBy("course_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "section", "modules"))), lambda s: F.struct(s["section"].alias("name"), s["modules"])).alias("sections"))


def enrolled(pattern: Column, index: Column) -> Column:
    """Whether a user with a pattern of 0 and 1 is in the course with an index; patterns repeat."""
    return F.substring(pattern, (F.pmod(index, F.length(pattern)) + 1).cast("int"), F.lit(1)) == "1"


def uploads(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the asked digests (sha256) those that a pushed document has, each once, with one of its files."""
    own = docs.where("file_sha256 IS NOT NULL").groupBy(F.col("file_sha256").alias("sha256")).agg(F.max_by("file", "doc_id").alias("file"))
    return wanted.select("sha256").distinct().join(own, "sha256")


def resumable(runs: DataFrame, now: int, stale: int = 23 * 3600) -> DataFrame:
    """Runs (id, state, timemodified) after the start of a sync: the latest running one that is not stale goes on, other running ones are abandoned."""
    live = runs.where((F.col("state") == "running") & (F.col("timemodified") > now - stale)).agg(F.max("id").alias("resume"))
    rows = runs.crossJoin(live)  # by one row
    ends = (F.col("state") == "running") & ~F.col("id").eqNullSafe(F.col("resume"))
    return rows.withColumns({"state": F.when(ends, "abandoned").otherwise(F.col("state")), "timemodified": F.when(ends, F.lit(now)).otherwise(F.col("timemodified"))}).drop("resume")


def next_slice(courses: DataFrame, chunkno: int, most: int) -> DataFrame:
    """The courses (pos, course_id) that a run does next, in order: those from its progress on, as many as a slice has time for."""
    return courses.where(F.col("pos") >= chunkno).orderBy("pos").limit(most)
