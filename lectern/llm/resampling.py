"""Importance resampling towards a target corpus, in DataFrame functions only.

Runs of words are features and fall into a fixed number of buckets by crc32. What a bucket's share in
the target is to its share in the documents is its gain; a document's weight is the sum of the gains of
its features, and noise by its id turns the highest sums of weight and noise into a draw without
replacement in proportion to the weights (Gumbel top-k).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import pick, ranked, stored

BUCKETS, RUN = 10_000, 1
#: What words are not made of: ASCII but for digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Steps of a score to one of the logarithm.
STEPS = 1000


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    # Blanks at the ends would give empty words; within there are none, as runs separate.
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def features(of: Column, most: int = RUN) -> Column:
    """All runs of 1 to ``most`` neighbouring words, joined by a space."""

    def run_of(n: int) -> Column:
        # Word by word: a slice would copy the whole array each time.
        made = F.transform(F.sequence(F.lit(0), F.size(of) - n), lambda i: F.concat_ws(" ", *(F.get(of, i + k) for k in range(n))))
        return F.when(F.size(of) >= n, made).otherwise(F.array().cast("array<string>"))

    runs = [of, *(run_of(n) for n in range(2, most + 1))]
    return reduce(lambda a, b: F.concat(a, b), runs)


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, most: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of column ``text`` in each bucket that has any, counted before the shuffle."""
    # The words as a column of their own, or each run would cut the text anew.
    found = texts.select(words(F.col("text")).alias("words")).select(F.explode(features(F.col("words"), most)).alias("feature"))
    return found.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from two tables of counts."""
    of = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = of.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    sums = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets))
    # The sums are one row.
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(STEPS * F.log(ratio)).cast("long").alias("gain"))


def noise(seed: int, doc_id: Column) -> Column:
    """A Gumbel variable by the id, in steps."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-STEPS * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, seed: int = 2024, most: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank.

    Of the documents with at least ``least`` words ``percent`` in a hundred are drawn, those with the
    highest scores; ``rank`` is their order from 1, null for the rest. Ties go to the smaller doc_id, null
    the smallest; rows that share it stand as they come.

    Null texts have no words, in the target too, so no features and weight 0; without any document or
    target text the gains are those of counts of 0. An empty ``docs`` gives no rows; columns whose names
    are like others do not matter. A row's features never meet those of others: they are summed in the
    task that cut its text. Rows are told apart by their place, so ``docs`` should read the same again.
    """
    base = pick(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    counted = stored(bucket_counts(base, most, buckets), "buckets")
    gain = stored(gains(counted, bucket_counts(pick(target, "text"), most, buckets), buckets), "gains")
    cut = base.select("row", "doc_id", words(F.col("text")).alias("words"))
    # A text without words stays, as one feature that is null.
    found = cut.select("row", "doc_id", F.size("words").alias("n_words"), F.explode_outer(features(F.col("words"), most)).alias("feature"))
    found = found.select("row", "doc_id", "n_words", bucket(F.col("feature"), buckets).alias("bucket"))
    # One row a bucket: at most ``buckets`` rows of two numbers.
    weighed = found.join(F.broadcast(gain), "bucket", "left").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))), "scores")
    able = scored.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    places = ranked(able.select("row", "doc_id", "score"), "place", F.desc("score"), F.asc("doc_id")).where(F.col("place") < drawn)
    return scored.join(places.select("row", (F.col("place") + 1).alias("rank")), "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
