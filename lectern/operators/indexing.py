"""What follows extraction, as one commit: chunks, content, index, and what becomes of the document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, live_index
from lectern.operators.store import index_outcome
from lectern.operators.versions import Snapshot

SEGMENTS = "doc_id {0}, ordinal int, text string, page int, label string"
CHUNKS = "doc_id {0}, ordinal int, page int, body string, header_text string, text string"


def create(spark, path: str, id_type: str = "long") -> Snapshot:
    """A store without content: segments, chunks, and the index of documents' texts."""
    none = spark.createDataFrame([], f"doc_id {id_type}, text string")
    return live_index.create(live_index.open_store(spark, path), none, {"segments": spark.createDataFrame([], SEGMENTS.format(id_type)), "chunks": spark.createDataFrame([], CHUNKS.format(id_type))})


def _texts(segments: DataFrame) -> DataFrame:
    """Of each document its segments in order, a blank line between."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: F.coalesce(s["text"], F.lit("")))
    return segments.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("text"))


def _lengths(segments: DataFrame) -> DataFrame:
    """Tokens of each document: those of its segments together, as the blank line between parts tokens too."""
    return segments.groupBy("doc_id").agg(F.sum(F.size(T.index_tokens("text"))).cast("int").alias("len"))


def _cut(segments: DataFrame, docs: DataFrame) -> DataFrame:
    return chunking.chunk_documents(segments.join(docs.select("doc_id", "header_path"), "doc_id"))


def index(state: Snapshot, docs: DataFrame, segments: DataFrame, ocr: bool = True, empty: str = "no-text") -> tuple[Snapshot, DataFrame]:
    """(the version in which ``docs`` have the content of ``segments``; doc_id, chunks, skip_reason and queue of each).

    docs: doc_id, header_path, kind, mimetype; segments: SEGMENTS and needs_ocr. A document asks for OCR where
    a page does, or where an image gave no text: then its ``queue`` is "ocr", or its reason "needs-ocr" without
    it; else one with chunks goes on to "embed", and one without has the reason ``empty``. Other readers see
    all of it or nothing.
    """
    chunks = _cut(segments.select("doc_id", "ordinal", "text", "page"), docs)
    own = segments.select("doc_id", "ordinal", "text", "page", "label")
    state = live_index.replace(state.store, docs, _texts(own), {"segments": own, "chunks": chunks}, state, _lengths(own))
    # Counted from what was committed: nothing is cut twice.
    n = state.table("chunks").join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    pages = segments.groupBy("doc_id").agg(F.bool_or(F.coalesce("needs_ocr", F.lit(False))).alias("page"))
    rows = docs.join(n, "doc_id", "left").join(pages, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    image = (F.col("chunks") == 0) & (F.col("kind") == "file") & F.coalesce(F.col("mimetype").startswith("image/"), F.lit(False))
    needs = F.coalesce("page", F.lit(False)) | image
    what = index_outcome(F.col("chunks"), needs, F.lit(ocr), empty)
    queue = F.when(what == "ocr", F.lit("ocr")).when(F.col("chunks") > 0, F.lit("embed"))
    return state, rows.select("doc_id", "chunks", F.nullif(what, F.lit("ocr")).alias("skip_reason"), queue.alias("queue"))


def rechunk(state: Snapshot, relocated: DataFrame) -> Snapshot:
    """The version in which the documents of ``relocated`` (doc_id, header_path) are cut again below their new header; their segments stay."""
    segments = state.table("segments").join(relocated.select("doc_id"), "doc_id", "left_semi")
    ids = segments.select("doc_id").distinct()
    return live_index.replace(state.store, ids, _texts(segments), {"segments": segments, "chunks": _cut(segments.select("doc_id", "ordinal", "text", "page"), relocated)}, state, _lengths(segments))
