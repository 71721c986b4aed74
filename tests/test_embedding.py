"""Vectors of the query that embeds documents."""

import math

from lectern.operators import embedding
from lectern.plans import queries


def test_documents_without_words_have_no_row_and_numbers_are_rounded_once(spark, tmp_path):
    texts = ["a b, 12", None, "netz netz aus", *(" ".join(["netz"] * n + ["turm"] * m) for n in range(1, 60) for m in range(1, 60))]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = [r["largest"] for r in queries.QUERIES["embed_documents"](spark, f"file://{tmp_path}").collect()]
    pairs = [(2, 1), *((n, m) for n in range(1, 60) for m in range(1, 60))]
    assert sorted(got) == sorted(math.floor(max(p) / math.sqrt(p[0] ** 2 + p[1] ** 2) * 1e4 + 0.5) / 1e4 for p in pairs)


def test_null_texts_go_to_no_embedder(spark):
    rows = spark.createDataFrame([("eins zwei",), (None,)], "text string")
    assert embedding.embed(rows, embedding.hash_embedder(8), "k").count() == 1
