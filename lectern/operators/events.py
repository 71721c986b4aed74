"""The conversation log: runs of streamed parts, replay, open questions, citations."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STREAMED = ("token", "thinking")
CLOSING = ("user_answer", "final", "cancelled", "error")


def islands(events: DataFrame, conv: str = "conversation_id", order: str = "seq", same: tuple[str, ...] = ("type", "turn_id")) -> DataFrame:
    """events with island, a number that goes up where type or turn change."""
    by = Window.partitionBy(conv).orderBy(order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(by))
    first = F.row_number().over(by) == 1
    return events.withColumn("new", (new | first).cast("int")).withColumn("island", F.sum("new").over(by)).drop("new")


def merge_runs(events: DataFrame) -> DataFrame:
    """Streamed runs as one event with the last seq, the joined delta and the parts' lengths; others as they are."""
    marked = islands(events)
    mine = F.when(F.col("type").isin(*STREAMED), F.lit(-1)).otherwise(F.col("seq"))
    got = marked.groupBy("conversation_id", "island", mine.alias("own")).agg(F.max("seq").alias("seq"), F.first("type").alias("type"), F.first("turn_id").alias("turn_id"), F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("run"))
    delta = F.array_join(F.transform("run", lambda e: F.coalesce(e["delta"], F.lit(""))), "")
    parts = F.transform("run", lambda e: F.length(F.coalesce(e["delta"], F.lit(""))))
    streamed, empty = F.col("type").isin(*STREAMED), F.forall("run", lambda e: e["delta"].isNull())
    return got.select("conversation_id", "seq", "type", "turn_id", F.when(~empty, delta).alias("delta"), F.when(streamed, parts).alias("parts"))


def replay(events: DataFrame, after_seq: Column | int) -> DataFrame:
    """What one who has seen up to a seq has not seen: later events, and the rest of runs seen in part."""
    after = F.lit(after_seq) if isinstance(after_seq, int) else after_seq
    seen = F.greatest(F.lit(0), after - (F.col("seq") - F.size("parts"))).cast("int")
    cut = F.aggregate(F.slice("parts", 1, F.greatest(F.lit(0), seen)), F.lit(0), lambda s, x: s + x)
    partly = F.col("parts").isNotNull() & (seen > 0)
    rest = F.when(partly, F.substring(F.coalesce("delta", F.lit("")), cut + 1, F.length(F.coalesce("delta", F.lit(""))))).otherwise(F.col("delta"))
    rows = events.where(F.col("seq") > after).withColumns({"rest": rest, "partly": F.coalesce(partly, F.lit(False))})
    return rows.where(~F.col("partly") | (F.col("rest") != "")).select(*(F.col("rest").alias(c) if c == "delta" else F.col(c) for c in events.columns if c != "parts"))


def number(events: DataFrame, conv: str = "conversation_id", *order: str) -> DataFrame:
    """A gapless seq per conversation."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(conv).orderBy(*order)).cast("long"))


def pending_question(events: DataFrame, conv: str = "conversation_id", question: str = "question", closing: tuple[str, ...] = CLOSING) -> DataFrame:
    """The last question of each conversation that nothing closed after it."""
    last = events.where(F.col("type").isin(question, *closing)).groupBy(conv).agg(F.max(F.struct("seq", "type")).alias("last"))
    return last.where(F.col("last.type") == question).select(conv, F.col("last.seq").alias("seq"))


def running_turn(turns: DataFrame) -> DataFrame:
    """The latest running or waiting turn of each conversation."""
    return turns.where(F.col("state").isin("running", "waiting")).groupBy("conversation_id").agg(F.max(F.struct("created_at", "turn_id"))["turn_id"].alias("turn_id"))


def interrupt_running(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a crash: (turns, in which running ones of known conversations are interrupted; site_id, user_id, conversation_id and turn_id of these)."""
    known = conversations.select("conversation_id", "site_id", "user_id")
    hit = turns.where("state = 'running'").join(known, "conversation_id").select("site_id", "user_id", "conversation_id", "turn_id")
    marked = turns.join(known.select("conversation_id", F.lit(True).alias("known")), "conversation_id", "left")
    now = marked.withColumn("state", F.when((F.col("state") == "running") & F.col("known"), "interrupted").otherwise(F.col("state")))
    return now.select(*turns.columns), hit


def citations(hits: DataFrame, answer: str = "answer_id") -> DataFrame:
    """(answer, doc_id, n, pages): documents numbered by first appearance, with their sorted distinct pages."""
    per = hits.groupBy(answer, "doc_id").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_set("page")).alias("pages"))
    return per.select(answer, "doc_id", F.row_number().over(Window.partitionBy(answer).orderBy("pos", "doc_id")).alias("n"), "pages")


def cited(answers: DataFrame, known: DataFrame, answer: str = "answer_id") -> DataFrame:
    """(answer, n, rank): numbers in [1] or [1, 3] of a text that are known, in order of first use."""
    marks = F.regexp_extract_all("text", F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    each = F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*")))
    used = answers.select(answer, F.posexplode(each).alias("pos", "n")).select(answer, "pos", F.col("n").cast("int").alias("n"))
    first = used.groupBy(answer, "n").agg(F.min("pos").alias("pos")).join(known.select(answer, "n"), [answer, "n"], "left_semi")
    return first.select(answer, "n", F.row_number().over(Window.partitionBy(answer).orderBy("pos")).alias("rank"))


def dedupe(rows: DataFrame, *key: str) -> DataFrame:
    """One row of each key (client message ids, seqs)."""
    return rows.dropDuplicates(list(key))


def burst(events: DataFrame, per_minute: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, event_id, allowed): at most so many allowed events in any 60 seconds; refused ones do not count.

    Each decision needs those before it, so sorted rows stream through a task that remembers only the
    times of a key's last allowed events, however many events a key has.
    """
    kind = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(arrived):
        now, recent = None, deque()
        for b in arrived:
            out = []
            for k, t in zip(b.column("key").to_pylist(), b.column("at").to_pylist(), strict=True):
                if k != now:
                    now, recent = k, deque()
                while recent and t - recent[0] >= 60.0:
                    recent.popleft()
                out.append(len(recent) < per_minute)
                if out[-1]:
                    recent.append(t)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("event_id"), pa.array(out, pa.bool_())], [key, "event_id", "allowed"])

    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").cast("double").alias("at"), "event_id")
    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(run, f"{key} {kind[key]}, event_id {kind['event_id']}, allowed boolean")
