"""What messages of language models and their tools hold, in JSON columns."""

from __future__ import annotations

import string
from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCKS = "array<struct<type: string, text: string>>"
_DETAILS = "array<struct<type: string, text: string, summary: string>>"
#: Which field of a reasoning detail holds its text, by its type.
DETAIL_TEXT = {"reasoning.text": "text", "reasoning.summary": "summary"}


def encoded(*cols: Column | str) -> Column:
    """A payload as JSON, without fields that are null."""
    return F.to_json(F.struct(*cols))


def message_text(blocks: Column) -> Column:
    """The joined text of a message's text blocks (a JSON array), never its reasoning."""
    own = F.filter(F.from_json(blocks, _BLOCKS), lambda b: b["type"] == "text")
    return F.array_join(F.transform(own, lambda b: F.coalesce(b["text"], F.lit(""))), "")


def usage_of(meta: Column) -> Column:
    """struct(input_tokens, output_tokens, reasoning_tokens) of usage metadata in JSON; null for none."""
    m = F.from_json(meta, "input_tokens long, output_tokens long, output_token_details struct<reasoning: long>")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return F.when(meta.isNotNull() & ~meta.isin("", "{}", "null"), F.struct(zero(m["input_tokens"]).alias("input_tokens"), zero(m["output_tokens"]).alias("output_tokens"), zero(m["output_token_details"]["reasoning"]).alias("reasoning_tokens")))


def reasoning_text(payload: Column) -> Column:
    """The reasoning of a message's JSON, from the first of its fields that has some; empty for none."""
    plain = [F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit("")) for k in ("reasoning_content", "reasoning")]
    details = F.from_json(F.get_json_object(payload, "$.reasoning_details"), _DETAILS)
    text = lambda d: F.coalesce(*(F.when(d["type"] == kind, d[name]) for kind, name in DETAIL_TEXT.items()), F.lit(""))
    return F.coalesce(*plain, F.array_join(F.transform(details, text), ""), F.lit(""))


def summary(template: str, arguments: dict, label: str) -> str:
    """A tool's summary: the template with its arguments, missing ones empty; the label where it cannot be filled in."""
    try:
        return string.Formatter().vformat(template, (), defaultdict(str, arguments))
    except (KeyError, ValueError, IndexError):
        return label
