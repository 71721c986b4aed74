"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Sorting all blocks, by a digest and then by their
bytes, names each distinct one by its rank; adjacent pairs of names are then sorted and named in the same way until each text has
one name. Texts with the same number of rounds and the same name are equal byte for byte: no hash
is involved. A sort by (block, row, position) splits even a block that a third of all rows share
over many tasks, and only the first and last block of each task meet to number the tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import partitions, pick, ship, stored

#: Bytes in a block.
BLOCK = 4096
#: Parts of each group of equal texts when its size is joined to its rows.
SALTS = 16


def _ranked(keys: list[str], rest: list[str]):
    """For sorted rows of one task: the task, the rank of each row's key, whether it differs from that before it though its digest does not, and the key itself on the first and last row."""

    def run(arrived):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        rank, last, held, digest = -1, None, None, None

        def out(b: pa.RecordBatch, ranks: np.ndarray, opens: bool, first: bool, final: bool) -> pa.RecordBatch:
            ends = ([0] if first else []) + ([b.num_rows - 1] if final else [])
            clash = np.zeros(b.num_rows, bool)
            digest = b.column("digest")
            clash[1:] = pc.fill_null(pc.and_(pc.equal(digest[1:], digest[:-1]), pa.array(np.diff(ranks) > 0)), False).to_numpy(zero_copy_only=False)
            clash[:1] = opens
            edge = [pa.array([b.column(k)[i].as_py() if i in ends else None for i in range(b.num_rows)] if ends else [None] * b.num_rows, b.schema.field(k).type) for k in keys]
            return pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(np.full(b.num_rows, task), pa.int32()), pa.array(ranks), pa.array(clash), pa.array(np.isin(np.arange(b.num_rows), ends)), *edge], [*rest, "task", "rank", "clash", "edge", *(f"edge_{k}" for k in keys)])

        first = True
        for b in arrived:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                c = b.column(k)
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            now = [b.column(k)[0].as_py() for k in keys]
            new[0] = last is None or now != last
            mark = b.column("digest")[0].as_py()
            opens = bool(new[0]) and last is not None and mark is not None and mark == digest
            digest = b.column("digest")[b.num_rows - 1].as_py()
            ranks = rank + np.cumsum(new, dtype=np.int64)
            rank, last = int(ranks[-1]), [b.column(k)[b.num_rows - 1].as_py() for k in keys]
            if held:
                yield out(*held, first, False)
                first = False
            held = (b, ranks, opens)
        if held:
            yield out(*held, first, True)

    return run


def _digest(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def named(rows: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """``rows`` (row, pos and others) with their ``keys`` replaced by ``name``, the rank of the keys among all distinct ones.

    Keys that are large are ranked by their digests first (``exact`` false), so that what is sampled for
    the ranges stays small. Where two different keys share a digest, which is looked for, it is all done
    again by the keys themselves: no digest decides.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in keys]
    of = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.withColumn("digest", F.lit(None).cast("long") if exact else _digest(keys))
    dealt = rows.repartitionByRange(partitions(spark), *(keys if exact else ["digest"]), "row", "pos").sortWithinPartitions("digest", *keys, "row", "pos")
    schema = ", ".join([f"{c} {of[c]}" for c in rest] + ["digest long", "task int", "rank long", "clash boolean", "edge boolean"] + [f"edge_{k} {of[k]}" for k in keys])
    ranked = stored(dealt.mapInArrow(_ranked(keys, [*rest, "digest"]), schema), "names")
    # One row for each task that had rows: few and small, so one window over all of them is no bottleneck.
    key = F.struct("digest", *(f"edge_{k}" for k in keys))
    tasks = ranked.where("edge").groupBy("task").agg((F.max("rank") + 1).alias("k"), F.min_by(key, "rank").alias("f"), F.max_by(key, "rank").alias("l"))
    by = Window.orderBy("task")
    before = F.lag("l").over(by)
    tasks = tasks.select("task", "k", F.coalesce(F.col("f") == before, F.lit(False)).cast("long").alias("same"), F.coalesce((F.col("f.digest") == before["digest"]) & (F.col("f") != before), F.lit(False)).alias("clash"))
    if not exact and not (ranked.where("clash").isEmpty() and tasks.where("clash").isEmpty()):
        return named(rows.drop("digest"), keys)
    before = F.sum(F.col("k") - F.col("same")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    offsets = tasks.select("task", (F.coalesce(before, F.lit(0)) - F.col("same")).alias("offset"))
    return ranked.join(F.broadcast(offsets), "task").select(*rest, (F.col("offset") + F.col("rank")).alias("name"))


def identities(docs: DataFrame, normalise: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, sha, rounds, name; equal texts, and only they, share rounds and name."""
    ship(docs.sparkSession)
    text = F.coalesce(normalise if normalise is not None else F.col("text"), F.lit(""))
    base = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", text.cast("binary").alias("bytes"))
    count = F.greatest(F.lit(1), F.ceil(F.length("bytes") / BLOCK).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("bytes"), i * BLOCK + 1, F.lit(BLOCK)))
    rows = base.select("row", "doc_id", F.sha2("bytes", 256).alias("sha"), count.alias("n"), F.posexplode(blocks).alias("pos", "block"))
    first = F.col("pos") == 0
    rows = rows.select("row", "pos", "n", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"), "block")
    done, rounds = [], 0
    at = named(rows, ["block"], exact=False)
    while True:
        done.append(at.where("n = 1").select("row", "doc_id", "sha", F.lit(rounds).alias("rounds"), "name"))
        left = at.where("n > 1")
        if left.isEmpty():
            return reduce(DataFrame.unionAll, done)
        even = F.col("pos") % 2 == 0
        pairs = left.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("half"), F.ceil(F.col("n") / 2).cast("int").alias("halves")).agg(F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"))
        at, rounds = named(pairs.select("row", F.col("half").alias("pos"), F.col("halves").alias("n"), "doc_id", "sha", "left", "right"), ["left", "right"]), rounds + 1


def exact_dedup(docs: DataFrame, normalise: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (after ``normalise``, an expression on ``text``; none: as they are) the row with
    the largest doc_id stays; among rows that also share the doc_id, one of them. Null texts equal
    empty ones. A null doc_id is the smallest. An empty table gives no rows; other columns are not
    read. Rows are told apart by their place in ``docs``, which should be a table that reads the
    same again, as Parquet files do.
    """
    ids = identities(docs, normalise)
    groups = ids.groupBy("rounds", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("stays")).where("group_size > 1")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = ids.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    alone = F.col("group_size").isNull()
    return mine.join(salted, ["rounds", "name", "salt"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("stays.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
