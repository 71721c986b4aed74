"""An inverted index that follows its documents: postings as one table of a versioned store.

A commit writes the postings of the documents that it brings and hides those of the documents it
touches; a query reads the parts of its terms in every layer and leaves out what is hidden. The number
of documents and of their tokens are sums in the version's notes, kept by adding what comes and taking
off what goes, for which only the lengths of touched documents are read. Scores equal those of an
index built anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import search
from lectern.operators.versions import Snapshot, Store

TABLES = ("lengths", "postings")


def lengths(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.select(key, F.size(T.index_tokens("text")).alias("len"))


def postings(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, key, len, positions, bucket, by part and term."""
    return search.laid_out(search.posted(chunks, key), key)


def tables(chunks: DataFrame, key: str = "doc_id", counted: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of the index of ``chunks`` (key, text), to be committed with others of the same store; ``counted`` has their lengths, where these are known."""
    return {"lengths": lengths(chunks, key) if counted is None else counted, "postings": postings(chunks, key)}


def _sums(rows: DataFrame) -> tuple[int, int]:
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
    return r["n"], r["tokens"]


def open_store(spark, path: str, key: str = "doc_id", partitions: dict[str, list[str]] | None = None) -> Store:
    return Store(spark, path, key, {**(partitions or {}), "postings": ["bucket"]})


def create(store: Store, chunks: DataFrame, others: dict[str, DataFrame] | None = None) -> Snapshot:
    """The first version: an index of ``chunks`` (one row a key), and other tables beside it."""
    layer = tables(chunks, store.key)

    def notes(written) -> dict:
        n, tokens = _sums(written("lengths"))
        return {"n": n, "tokens": tokens}

    return store.create({**(others or {}), **layer}, notes)


def replace(store: Store, ids: DataFrame, chunks: DataFrame, others: dict[str, DataFrame] | None = None, base: Snapshot | None = None, counted: DataFrame | None = None) -> Snapshot:
    """The next version, in which the documents ``ids`` are indexed as ``chunks`` has them, or not at all; ``counted`` as in ``tables``."""
    base = base or store.snapshot()
    gone: list[tuple[int, int]] = []

    def fresh(touched: DataFrame) -> dict[str, DataFrame]:
        gone.append(_sums(base.table("lengths").join(touched, store.key, "left_semi")))
        own = None if counted is None else counted.join(touched, store.key, "left_semi")
        return tables(chunks.join(touched, store.key, "left_semi"), store.key, own)

    def notes(written) -> dict:
        # Both sums are of the touched documents alone.
        (out_n, out_tokens), (in_n, in_tokens) = gone[0], _sums(written("lengths"))
        return {**base.notes, "n": base.notes["n"] - out_n + in_n, "tokens": base.notes["tokens"] - out_tokens + in_tokens}

    return store.replace(ids, others or {}, base, notes, fresh)


def compact(store: Store, base: Snapshot | None = None) -> Snapshot:
    """The same index in one layer, its postings in order again."""
    return store.compact(base, {"postings": lambda p: search.laid_out(p, store.key)})


def bm25(index: Snapshot, query: str, mode: str = "any", scope: DataFrame | None = None) -> DataFrame:
    """key and score as ``search.bm25`` over the documents of this version; only the parts of the query's terms are read."""
    key, n = index.store.key, index.notes["n"]
    stats = index.store.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(index.notes["tokens"] / n if n else 0.0).alias("avg"))
    return search.from_postings(lambda where: index.table("postings", where), stats, query, mode, key, scope)


def ranking(index: Snapshot) -> search.Ranking:
    """What ``search.hybrid``, ``search.text_search`` and the tools take as their index."""
    return lambda query, mode, scope: bm25(index, query, mode, scope)
