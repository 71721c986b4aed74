"""The loop that embeds what has no vector."""

from pyspark.sql import functions as F

from lectern.operators import embed_loop, embedding


def good(texts):
    if any("bad" in t for t in texts):
        raise embedding.EmbeddingFailed
    return [[float(len(t)), 1.0] for t in texts]


def down(texts):
    raise embedding.EmbeddingFailed


def seen(state):
    return sorted(r["chunk_id"] for r in state.table("vectors").collect()), {r["chunk_id"]: r["n"] for r in state.table("failures").collect()}


def test_passes_resume_leave_out_poisoned_and_heed_gates(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "s", "eins"), (2, "s", "bad"), (3, "t", "drei" * 100), (4, "s", None)], "chunk_id long, site_id string, text string")
    state = embed_loop.create(spark, f"file://{tmp_path}/v")
    state, works = embed_loop.run(chunks, state, good)
    assert works and seen(state) == ([1, 3], {2: 1}) and {r["site_id"]: r["tokens"] for r in embed_loop.usage(state).collect()} == {"s": 1, "t": 100}
    # Nothing but what is refused: the provider counts as down, and its failures do not.
    again, works = embed_loop.run(chunks, state, good)
    assert not works and seen(again) == ([1, 3], {})
    # With one that is taken beside it the failures count, here in two batches with a gate that is asked before each.
    more = chunks.unionByName(spark.createDataFrame([(i, "t", "neu") for i in (6, 8)] + [(7, "u", "neu"), (9, "u", "neu")], chunks.schema))
    asked = []

    def gate(s):
        asked.append(s.version)
        return embed_loop.usage(s).where("tokens >= 100").select("site_id")

    state, works = embed_loop.run(more, again, good, gate, batches=2, deal=F.when(F.col("chunk_id").isin(2, 7), 0).otherwise(1))
    assert asked == [again.version, again.version + 1]
    assert works and seen(state) == ([1, 3, 7, 9], {2: 1})
    # All of a pass refused by the provider.
    state, works = embed_loop.run(more, state, down)
    assert not works and seen(state) == ([1, 3, 7, 9], {})
