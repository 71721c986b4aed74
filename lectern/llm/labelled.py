"""A bounded sample of labelled texts, for fitting models."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import pick, stored

#: Rows of each class in the sample, and bytes of their texts together.
PER_CLASS, BYTES = 3000, 6 << 20
#: Bytes of one text; of longer ones a passage of as many letters as surely fit is in the sample.
LONGEST = 64 << 10


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = PER_CLASS, most_bytes: int = BYTES) -> tuple[pa.Table, dict[int, int]]:
    """(doc_id, text, y of the sample; rows of each class among all labels that may be learnt from).

    ``learn`` is a condition on doc_id. Of each class the ``per_class`` rows with the smallest hash of
    doc_id are taken, and of these as many, in that order, as have ``most_bytes`` of text together, so
    twice that reaches the driver. A text of more than LONGEST bytes is there by a passage, at a place by
    its doc_id, so that no text, however long, keeps others out. Labels other than 0 and 1, null ids and texts are left out.
    """
    known = pick(labels, "doc_id", label).select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    prior = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    ids = None
    for y in (0, 1):
        own = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = own if ids is None else ids.unionAll(own)
    letters = LONGEST // 4
    first = F.pmod(F.xxhash64("doc_id"), F.length("text") - letters + 1) + 1
    passage = F.when(F.octet_length("text") <= LONGEST, F.col("text")).otherwise(F.substring("text", first.cast("int"), F.lit(letters)))
    texts = pick(docs, "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", passage.alias("text"))
    # At most 2 * per_class rows of two numbers: a proven bound, also for those of the window and the second join.
    sizes = texts.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.sum("bytes").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    taken = F.col("before") <= F.greatest(F.lit(most_bytes), F.col("bytes"))  # the first always is
    ids = stored(sizes.withColumn("before", before).where(taken).select("doc_id", "y"), "sample")
    got = texts.join(F.broadcast(ids), "doc_id").toArrow()
    return got.sort_by([("doc_id", "ascending")]), prior
