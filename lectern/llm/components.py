"""Connected components of a graph given by its edges, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored


def _state(edges: DataFrame):
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that can be reached.

    Alternates two steps until nothing changes, which takes a number of rounds that grows with the
    logarithm of the graph: every node links its larger neighbours to its smallest one, then every
    node links its smaller neighbours and itself to the smallest. Both are a grouped minimum
    (combined before the shuffle) and an equi-join whose hot nodes adaptive execution can split.
    Each round is written to the shared folder. Loops and repeated edges do no harm; no edges give
    no rows.
    """
    at = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, now = None, _state(at)
    while now != before and now[0]:
        both = at.unionAll(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # a > b holds in every row, so b's larger neighbours are the a's.
        large = at.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).where("a <> b")
        least_large = at.join(least, "a").select("a", F.col("m").alias("b")).where("a <> b")
        large = stored(large.unionAll(least_large).distinct(), "large")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        at = stored(small.unionAll(smallest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, now = now, _state(at)
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(at.select("b", F.col("b").alias("root")).distinct())
