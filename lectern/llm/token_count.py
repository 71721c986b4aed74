"""Token counts: whole texts are encoded in Arrow functions that return lengths only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lectern.llm import encode
from lectern.llm.common import pick, ship


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Batches hold about the same number of bytes and long texts are cut at places where no token
    can reach over. Null and empty texts have 0 bytes and tokens; repeated rows give repeated
    rows; a null doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)

    def count(arrived):
        for b in arrived:
            text = pc.fill_null(b.column("text"), "")
            n = encode.count(text, tokenizer)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, "doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
