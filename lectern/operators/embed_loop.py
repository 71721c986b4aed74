"""Embedding what has no vector yet, in batches that are each one commit.

Vectors, failures and usage are tables of a versioned store by chunk; what is left to do is an anti
join with its newest version, so a run that was stopped goes on where its last commit was, and one that
lost against another writer does that batch again next time. Before each batch the sites that may not
spend more are asked for anew.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import embedding, jobs
from lectern.operators.versions import Snapshot, Store

#: Failures after which a chunk is left out, and letters of a token where providers do not tell.
POISONED, LETTERS = 3, 4


def create(spark: SparkSession, path: str, id_type: str = "long") -> Snapshot:
    """A store without vectors."""
    schemas = {"vectors": "vector array<float>", "failures": "n int", "usage": "site_id string, tokens long"}
    return Store(spark, path, "chunk_id").create({t: spark.createDataFrame([], f"chunk_id {id_type}, {s}") for t, s in schemas.items()})


def usage(state: Snapshot) -> DataFrame:
    """Tokens spent by site."""
    return state.table("usage").groupBy("site_id").agg(F.sum("tokens").alias("tokens"))


def pending(chunks: DataFrame, state: Snapshot, gated: DataFrame | None = None) -> DataFrame:
    """Chunks (chunk_id, site_id, text) without a vector that did not fail too often, of sites that are not gated."""
    bad = state.table("failures").where(F.col("n") >= POISONED)
    rows = jobs.waiting_for_vectors(chunks, state.table("vectors"), poisoned=bad)
    return rows if gated is None else rows.join(gated.select("site_id"), "site_id", "left_anti")


def run(chunks: DataFrame, state: Snapshot, embedder: Callable[[list[str]], np.ndarray], gate: Callable[[Snapshot], DataFrame] | None = None, batches: int = 1, deal: Column | None = None) -> tuple[Snapshot, bool]:
    """One pass over what is pending, in ``batches`` (of ``deal``, a number for each chunk): the newest version, and whether the provider works.

    A chunk with a vector has no failures; one that fails has one more. Where a batch has no success at
    all, the provider is down: its failures, and all before, do not count, and the pass ends. A batch with
    nothing to do commits nothing.
    """
    deal = F.xxhash64("chunk_id") if deal is None else deal
    for i in range(batches):
        todo = pending(chunks.where(F.pmod(deal, F.lit(batches)) == i), state, gate(state) if gate else None).select("chunk_id", "site_id", "text").where("text IS NOT NULL")
        got = embedding.embed(todo.withColumn("lookup", F.col("chunk_id").cast("string")), embedder, "")
        rows = todo.withColumn("lookup", F.col("chunk_id").cast("string")).join(got, "lookup")
        store, done = state.store, _written(state, rows)
        counts = done.agg(F.count("*").alias("n"), F.count("vector").alias("good")).first()
        if not counts["n"]:
            continue
        if not counts["good"]:
            failed = state.table("failures")
            return (store.replace(failed, {}, state) if not failed.isEmpty() else state), False
        good, bad = done.where("vector IS NOT NULL"), done.where("vector IS NULL")
        before = state.table("failures").select("chunk_id", F.col("n").alias("before"))
        state = store.replace(
            done,
            {
                "vectors": good.select("chunk_id", "vector"),
                "failures": bad.join(before, "chunk_id", "left").select("chunk_id", (F.coalesce("before", F.lit(0)) + 1).cast("int").alias("n")),
                "usage": good.select("chunk_id", "site_id", F.greatest(F.lit(1), F.floor(F.col("letters") / LETTERS)).cast("long").alias("tokens")),
            },
            state,
        )
    return state, True


def _written(state: Snapshot, rows: DataFrame) -> DataFrame:
    """A batch's outcome, stored, as it is read several times and a provider is paid for each call."""
    from lectern.plans.storage import scratch

    at = scratch(state.store.spark, "embedded")
    out = rows.select("chunk_id", "site_id", F.length("text").alias("letters"), "vector")
    out.write.parquet(at)
    return state.store.spark.read.schema(out.schema).parquet(at)
