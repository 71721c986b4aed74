"""What the operators of this subpackage share: shared storage, code shipping, input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.plans import shipping
from lectern.plans.storage import scratch

#: Spark deletes a query's shuffle files at its end where this is set, instead of when the driver happens to collect garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage, survives lost executors, and fixes what is not deterministic. The shuffle
    files of the writing go with it, and the table when the application's folder does.
    """
    spark = df.sparkSession
    path, told = scratch(spark, name), spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_CLEAN, told)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes in one Arrow batch, so that batches of long texts stay small.
ARROW_BYTES = "16m"


def ship(spark: SparkSession) -> None:
    """Make Python tasks possible: small Arrow batches, and this package on the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    shipping.ship(spark)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns with exactly these names; others, clashing ones too, do not matter."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores until none of ``taken`` is the same but for case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` and ``name``, the place of each row in ``order``, from 0: sorted in ranges, counted within each, and shifted by the counts of those before.

    Rows that ``order`` does not tell apart are numbered as they come. Of the ranges, whose number is
    that of shuffle partitions, one row each meets to be summed; no row but these goes to one task.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # This id is the task's number (from bit 33 on) and the row's place in it.
    at = stored(dealt.withColumn(name, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(name, 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = at.join(F.broadcast(counts), part == F.col("_part"))
    return joined.select(*df.columns, (F.col(name).bitwiseAND((1 << 33) - 1) + F.col("_before")).alias(name))


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") * F.lit(2.0**-53)


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
