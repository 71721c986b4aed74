"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is the number of copies each of its documents is due: a whole part
and a fraction. Fractions become 0 or 1 pair by pair: a random amount of words moves from one
document of a pair to the other, such that each keeps its expected copies and their sum of words
stays, until one of them is whole; the other meets the next. Documents are dealt by a hash into
groups of about ``FAN``; what is left of each group, one fraction at most, meets those of other
groups one level up, until a source has one, which a last draw decides. So a source's words miss
its target by less than one document; a group takes its longest documents first, so that the one
left at the end tends to be short. A source with a third of all rows is as spread as others.
All draws are hashes of ids: reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import pick, stored, uniform

#: Fractions that meet in one group of the reduction tree.
FAN = 256
#: What counts as a word, and the weights of the sources in order.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Sources up to this number are broadcast to their documents; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def sizes(docs: DataFrame) -> DataFrame:
    """row (place in ``docs``), doc_id, source and size, the number of words."""
    return pick(docs, "doc_id", "source", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, docs, source_size, target of each source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all words;
    none gets more than ``cap`` times its own, and what that leaves goes to the others by weight.
    One row per source goes through windows over all sources.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight).withColumn("full", F.col("source_size") * cap)
    # The level at which all sources that are not full get the same words by weight.
    by_need = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = F.sum("source_size").over(Window.partitionBy()) * share
    before = F.coalesce(F.sum("full").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    others = F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (everything - before) / others)
    per = per.withColumn("at", F.row_number().over(by_need)).withColumn("fits", F.when(F.col("full") / F.col("weight") >= F.col("level"), F.struct("at", "level")))
    level = F.min("fits").over(Window.partitionBy())["level"]
    return per.withColumn("target", F.coalesce(F.least("full", level * F.col("weight")), F.col("full"))).select("source", "docs", "source_size", "target")


#: The fields of one fraction: its document, words, fraction p, and what else belongs to it.
_ITEM = ("row", "doc_id", "size", "tie", "p")


def _fold(items: Column, level: int, seed: int) -> Column:
    """struct(left: the fraction that is left or null, done: array of those that became 0 or 1)."""

    def item(x: Column, p: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in _ITEM[:-1]), p.alias("p"))

    def meet(acc: Column, e: Column) -> Column:
        a = acc["left"]
        wa, wb = a["size"] * a["p"], e["size"] * e["p"]  # words that each holds
        ra, rb = a["size"] * (1 - a["p"]), e["size"] * (1 - e["p"])  # and that each has room for
        to_a, to_e = F.least(ra, wb), F.least(rb, wa)
        u = uniform(F.lit(seed), F.lit(level), a["doc_id"], e["doc_id"], a["size"], e["size"], a["tie"], e["tie"])
        gain = u * (to_a + to_e) < to_e
        pa = F.when(gain, F.when(ra <= wb, 1.0).otherwise((wa + to_a) / a["size"])).otherwise(F.when(wa <= rb, 0.0).otherwise((wa - to_e) / a["size"]))
        pe = F.when(gain, F.when(wb <= ra, 0.0).otherwise((wb - to_a) / e["size"])).otherwise(F.when(rb <= wa, 1.0).otherwise((wb + to_e) / e["size"]))
        na, ne = item(a, pa), item(e, pe)
        whole_a, whole_e = na["p"].isin(0.0, 1.0), ne["p"].isin(0.0, 1.0)
        none = F.lit(None)
        met = F.struct(
            F.when(~whole_a, na).when(~whole_e, ne).otherwise(none).alias("left"),
            F.concat(acc["done"], F.filter(F.array(na, ne), lambda x: x["p"].isin(0.0, 1.0))).alias("done"),
        )
        return F.when(a.isNull(), F.struct(item(e, e["p"]).alias("left"), acc["done"].alias("done"))).otherwise(met)

    kind = "struct<row: bigint, doc_id: bigint, size: bigint, tie: bigint, p: double>"
    start = F.struct(F.lit(None).cast(kind).alias("left"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(items, start, meet)


def rounded(fractions: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """row, p (0 or 1) of each of ``fractions`` (source, docs, row, doc_id, size > 0, tie, 0 < p < 1).

    ``most`` is the number of fractions of the largest source.
    """
    done, at, level = [], fractions.select("source", F.col("docs").alias("left_over"), *_ITEM), 0
    while most > 1 or level == 0:
        groups = F.ceil(F.col("left_over") / FAN).cast("long")
        dealt = at.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size", "tie"), groups))
        met = dealt.groupBy("source", "group", groups.alias("left_over")).agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "row", "tie", "p")), asc=False).alias("items"))
        met = stored(met.select("source", "left_over", _fold(F.col("items"), level, seed).alias("x")), "met")
        done.append(met.select(F.explode("x.done").alias("e")).select("e.row", "e.p"))
        at = met.where("x.left IS NOT NULL").select("source", "left_over", "x.left.*")
        most, level = -(-most // FAN), level + 1
    last = uniform(F.lit(seed), F.lit(-1), F.col("doc_id"), F.col("tie")) < F.col("p")
    return reduce(DataFrame.unionAll, [*done, at.select("row", last.cast("double"))])


def _with_ties(sized: DataFrame) -> DataFrame:
    """``sized`` with tie: 0, but for rows that share a doc_id their place, so that these are dealt like others."""
    again = sized.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"), F.lit(True).alias("shared"))
    return sized.join(again, F.col("doc_id").eqNullSafe(F.col("again")), "left").withColumn("tie", F.when(F.col("shared"), F.col("row")).otherwise(F.lit(0))).drop("again", "shared")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, source, size, source_size, target, copies, taken.

    taken is copies times size. Null and empty texts have no words and take none; a null source is
    one of its own; repeated rows, and others that share a doc_id or have none, are drawn each, by their place; an empty table gives no rows; other columns are not read. ``row`` is the
    place in ``docs``, which should be a table that reads the same again.
    """
    sized = stored(_with_ties(stored(sizes(docs).withColumn("doc_id", F.col("doc_id").cast("long")), "sizes")), "ties")
    per = stored(targets(sized, share, cap, weights), "targets")
    count, most = per.agg(F.count("*"), F.max("docs")).first()
    small = F.broadcast(per) if count <= BROADCAST_ROWS else per
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(small.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("due", due).withColumn("whole", F.floor("due"))
    rows = rows.withColumn("p", F.col("due") - F.col("whole"))
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    drawn = rounded(rows.where(open_).select("source", "docs", *_ITEM), most or 0, seed).select(F.col("row").alias("of"), F.col("p").alias("x"))
    rows = rows.join(drawn, F.col("row") == F.col("of"), "left")
    copies = (F.col("whole") + F.coalesce("x", F.lit(0.0))).cast("long")
    return rows.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it; rows without words stay as they are.

    Null and empty texts have no words; repeated rows are drawn each; an empty table gives no rows; all
    columns stay, whatever their names. ``docs`` should be a table that reads the same again.
    """
    times = mix(docs, **how).select(F.col("row").alias("of"), F.when(F.col("size") > 0, F.col("copies")).otherwise(1).cast("int").alias("times")).where("times > 0")
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("row", F.monotonically_increasing_id())
    rows = rows.join(times, F.col("row") == F.col("of")).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
