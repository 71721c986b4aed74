"""Ranked retrieval: BM25 over words and phrases, exact cosine, regular expressions, rank fusion.

Scores come from one scan of the chunks, in which each text becomes one line of tokens and per query
term an expression counts its occurrences there, so nothing is exploded or shuffled before the top-k;
or from a stored index, of which a query reads the files of its terms alone. Corpus statistics are one
row, used as a scalar subquery. Scores are rounded before ranking, and ties go by chunk id.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vectors as V

DEPTH, RRF_K, K1, B = 50, 60, 1.2, 0.75
PREFIX_FROM = 4


def query_terms(query: str, mode: str = "any") -> list[tuple[list[str], bool]]:
    """(sub-tokens in sequence, whether the last may go on) of each term of a query; any input is safe."""
    words = [t for t in re.split(r"[^\w\-.]+", query) if t]
    words = [" ".join(words)] if mode == "phrase" and words else words
    terms = []
    for w in words:
        table = str.maketrans(T.FOLD_FROM, T.FOLD_TO)
        parts = [p for p in re.split(r"[\W_]+", w.lower().translate(table)) if p]
        if parts:
            terms.append((parts, mode != "phrase" and len(w) >= PREFIX_FROM))
    return terms


def token_line(c: Column | str) -> Column:
    """All tokens with a blank before and after each; a single blank for none."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(T.fold(F.coalesce(T.col(c), F.lit(""))), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")))


def occurrences(line: Column, parts: list[str], prefix: bool) -> Column:
    """How often a term's sub-tokens stand side by side in a line of tokens; overlapping ones count each."""
    return F.regexp_count(line, F.lit(f"(?<= )(?={re.escape(' '.join(parts))}{'' if prefix else ' '})"))


def scored(rows: DataFrame, stats: Column, terms: int, mode: str, key: str) -> DataFrame:
    """key and score of rows (key, len, f0, f1, ...) by statistics (n, avg, n0, n1, ...); rows without the terms drop out."""
    found = [F.col(f"f{i}") > 0 for i in range(terms)]
    # A filter on a column that is not deterministic stays above the counting, which would else be done again below it.
    rows = rows.withColumn("at", F.monotonically_increasing_id()).where(reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), found) & (F.col("at") >= 0)).withColumn("s", stats)
    size = K1 * (1 - B + B * F.col("len") / F.col("s.avg"))
    part = [F.greatest(F.ln((F.col("s.n") - F.col(f"s.n{i}") + 0.5) / (F.col(f"s.n{i}") + 0.5)), F.lit(1e-6)) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + size) for i in range(terms)]
    return rows.select(key, F.round(reduce(lambda a, b: a + b, part), 6).alias("score"))


def bm25(chunks: DataFrame, query: str, mode: str = "any", key: str = "doc_id", columns: tuple[str, ...] = ("text",), scope: DataFrame | None = None) -> DataFrame:
    """key and score of the chunks that match; statistics are of all chunks, candidates of ``scope`` (key) only."""
    terms = query_terms(query, mode)
    if not terms:
        return chunks.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    lines = chunks.select(key, *(token_line(c).alias(f"t{i}") for i, c in enumerate(columns)))
    each = [reduce(lambda a, b: a + b, [occurrences(F.col(f"t{i}"), *t) for i in range(len(columns))]).alias(f"f{n}") for n, t in enumerate(terms)]
    length = reduce(lambda a, b: a + b, [F.length(f"t{i}") - F.length(F.replace(F.col(f"t{i}"), F.lit(" "), F.lit(""))) - 1 for i in range(len(columns))])
    counted = lines.select(key, length.alias("len"), *each)
    stats = counted.select(F.struct(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms)))).alias("s")).scalar()
    rows = counted if scope is None else counted.join(scope.select(key), key, "left_semi")
    return scored(rows, stats, len(terms), mode, key)


#: Letters that terms in one part of an index begin with, and the number of parts.
LEADING, BUCKETS = 3, 256


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, LEADING)), F.lit(BUCKETS)).cast("int")


#: Rows in one Arrow batch of postings.
POSTED = 100_000


def posted(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, key, len, positions and bucket of ``chunks`` (one row a key), grouped where a text is read: no token is shuffled by itself."""
    kind = chunks.schema[key].dataType.simpleString()

    def run(arrived):
        for batch in arrived:
            texts = batch.column(1)
            n = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            words = texts.flatten().dictionary_encode()
            if not len(words):
                continue
            doc = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            code = words.indices.to_numpy().astype(np.int64)
            # A term's rows stand together, which the shuffle's files get smaller by; places stay in order.
            order = np.argsort(code * len(n) + doc, kind="stable")
            doc, code, pos = doc[order], code[order], pa.array(pos[order].astype(np.int32))
            at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])
            places = pa.ListArray.from_arrays(pa.array(np.r_[at, len(doc)].astype(np.int32)), pos)
            rows = [words.dictionary.take(pa.array(code[at])), batch.column(0).take(pa.array(doc[at])), pa.array(n[doc[at]].astype(np.int32)), places]
            made = pa.RecordBatch.from_arrays(rows, ["term", key, "len", "positions"])
            for first in range(0, made.num_rows, POSTED):
                yield made.slice(first, POSTED)

    each = chunks.select(key, T.index_tokens("text").alias("t")).mapInArrow(run, f"term string, {key} {kind}, len int, positions array<int>")
    return each.withColumn("bucket", bucket(F.col("term")))


def laid_out(postings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Postings by part and term in one shuffle without a sample before it; parts that get large are dealt to several tasks and files."""
    return postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", key)


def write_index(chunks: DataFrame, path: str, key: str = "doc_id") -> None:
    """The inverted index of ``text``: postings in parts by their terms' first letters, sorted by term, and a row of statistics.

    A part whose terms are frequent is several files, each of which is sorted.
    """
    rows = chunks.select(key, F.size(T.index_tokens("text")).alias("len"))
    rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).write.parquet(f"{path}/stats")
    laid_out(posted(chunks, key), key).write.partitionBy("bucket").parquet(f"{path}/postings")


def indexed_bm25(spark: SparkSession, path: str, query: str, mode: str = "any", key: str = "doc_id", scope: DataFrame | None = None) -> DataFrame:
    """The same as ``bm25`` from an index: only the parts of the query's terms are read, and of these the row groups with the terms."""
    postings = spark.read.parquet(f"{path}/postings")
    return from_postings(lambda where: postings if where is None else postings.where(where), spark.read.parquet(f"{path}/stats"), query, mode, key, scope)


def from_postings(read: Callable[[Column | None], DataFrame], stats: DataFrame, query: str, mode: str = "any", key: str = "doc_id", scope: DataFrame | None = None) -> DataFrame:
    """key and score from postings (bucket, term, key, len, positions), which ``read`` gives for a condition, and one row of statistics (n, avg)."""
    terms = query_terms(query, mode)
    if not terms:
        return read(F.lit(False)).select(key, F.lit(0.0).alias("score"))

    def of(part: str, prefix: bool) -> DataFrame:
        held = F.col("term").startswith(part) if prefix else F.col("term") == part
        # The part's number is a constant, which the scan prunes folders by.
        rows = read(held if prefix and len(part) < LEADING else (F.col("bucket") == bucket(F.lit(part))) & held)
        return rows.groupBy(key, "len").agg(F.flatten(F.collect_list("positions")).alias("p")) if prefix else rows.select(key, "len", F.col("positions").alias("p"))

    def back(k: int) -> Column:
        return F.transform("p", lambda x: x - k)

    def found(parts: list[str], prefix: bool, i: int) -> DataFrame:
        rows = of(parts[0], prefix and len(parts) == 1)
        for k, part in enumerate(parts[1:], start=1):
            nxt = of(part, prefix and k == len(parts) - 1).select(key, back(k).alias("q"))
            rows = rows.join(nxt, key).select(key, "len", F.array_intersect("p", "q").alias("p"))
        return rows.where(F.size("p") > 0).select(key, "len", F.lit(i).alias("i"), F.size("p").alias("f"))

    every = reduce(DataFrame.unionAll, [found(*t, i) for i, t in enumerate(terms)])
    rows = every.groupBy(key, "len").agg(*(F.coalesce(F.sum(F.when(F.col("i") == i, F.col("f"))), F.lit(0)).alias(f"f{i}") for i in range(len(terms))))
    # Counted from the same grouping, whose exchange is read twice and made once.
    counts = rows.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))))
    told = stats.crossJoin(counts).select(F.struct("n", "avg", *(f"n{i}" for i in range(len(terms)))).alias("s")).scalar()  # one row by one row
    rows = rows if scope is None else rows.join(scope.select(key), key, "left_semi")
    return scored(rows, told, len(terms), mode, key)


def top(df: DataFrame, score: str, k: int, key: str = "doc_id", smallest: bool = False) -> DataFrame:
    """The best k rows, ties by key."""
    return df.orderBy(F.col(score).asc() if smallest else F.col(score).desc(), key).limit(k)


def cosine(vectors: DataFrame, query: Column, key: str = "vec_id", column: str = "embedding", scope: DataFrame | None = None) -> DataFrame:
    """key and exact cosine distance to one vector, of rows in scope."""
    rows = vectors if scope is None else vectors.join(scope.select(key), key, "left_semi")
    rows = rows.select(key, column, query.alias("query_vector"))  # apart, as the query may be a subquery
    return rows.select(key, F.round(V.cosine_distance(column, "query_vector"), 6).alias("distance"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """A 1-based rank. For lists already cut to a few rows: the window takes all of them."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(lists: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of lists (key, rank): key, score, sources, in the lists' order."""
    every = reduce(DataFrame.unionAll, [df.select(key, "rank", F.lit(i).alias("at"), F.lit(n).alias("name")) for i, (n, df) in enumerate(lists.items())])
    got = every.groupBy(key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 8).alias("score"), F.sort_array(F.collect_list(F.struct("at", "name"))).alias("by"))
    return got.select(key, "score", F.array_join("by.name", ",").alias("sources"))


#: What gives key and score of a query (text, mode, scope): ``bm25`` over texts, or over an index.
Ranking = Callable[[str, str, DataFrame | None], DataFrame]


def scanned(chunks: DataFrame) -> Ranking:
    return lambda query, mode, scope: bm25(chunks, query, mode, scope=scope)


def hybrid(chunks: DataFrame, vectors: DataFrame | None, query: str, vector: Column | None, k: int = 8, mode: str = "any", scope: DataFrame | None = None, index: Ranking | None = None) -> DataFrame:
    """Keywords and vectors fused; keywords alone where there are no vectors. With ``index`` the texts are not read."""
    lexical = top((index or scanned(chunks))(query, mode, scope), "score", DEPTH)
    lists = {"text": ranked(lexical, F.desc("score"), F.col("doc_id"))}
    if vectors is not None and vector is not None:
        near = cosine(vectors, vector, scope=None if scope is None else scope.withColumnRenamed("doc_id", "vec_id"))
        near = top(near, "distance", DEPTH, "vec_id", smallest=True).withColumnRenamed("vec_id", "doc_id")
        lists["vector"] = ranked(near, F.col("distance"), F.col("doc_id"))
    return top(fuse(lists), "score", k)


def text_search(chunks: DataFrame, query: str, k: int = 8, mode: str = "any", scope: DataFrame | None = None, index: Ranking | None = None) -> DataFrame:
    """Keywords alone, scored by rank."""
    got = ranked(top((index or scanned(chunks))(query, mode, scope), "score", k), F.desc("score"), F.col("doc_id"))
    return got.select("doc_id", F.round(1.0 / (RRF_K + F.col("rank")), 8).alias("score"), "rank")


def hydrate(hits: DataFrame, docs: DataFrame, most: int = 500) -> DataFrame:
    """Hits (few) with their text's beginning; those whose document is gone drop out."""
    return docs.join(F.broadcast(hits), "doc_id").select(*hits.columns, T.snippet("text", most).alias("snippet"))


MAX_PATTERN = 200
#: Fixed value: a group that ends in a repetition and is repeated itself.
_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*}]\)\s*[+*{]")


def checked_pattern(pattern: str) -> str:
    """The pattern, unless it is too long, does not compile or repeats a repetition."""
    if not pattern or len(pattern) > MAX_PATTERN:
        raise ValueError("a pattern has 1 to 200 characters")
    if _NESTED.search(pattern):
        raise ValueError("nested quantifiers are not supported")
    re.compile(pattern)
    return pattern


def regex_matches(segments: DataFrame, pattern: str, ignore_case: bool = False, context: int = 120, order: tuple[str, ...] = ("doc_id",), most: int | None = 20) -> DataFrame:
    """Matches in corpus order with the characters around each: order columns (which name a segment), n, start, match, around.

    Rows carry a match and the length of the text before it; starts are running sums of these within a
    segment, and the text comes in again where context is cut, after the limit.
    """
    p = ("(?iU)" if ignore_case else "(?U)") + checked_pattern(pattern)
    rows = segments.where(F.col("text").rlike(p))
    parts = F.zip_with(F.regexp_extract_all("text", F.lit(p), F.lit(0)), F.transform(F.split("text", p, -1), F.length), lambda m, n: F.struct(m.alias("match"), n.alias("before")))
    each = rows.select(*order, F.posexplode(parts).alias("n", "part")).where("part.match IS NOT NULL").select(*order, "n", "part.*")
    own = Window.partitionBy(*order).orderBy("n")
    each = each.withColumn("start", (F.sum("before").over(own) + F.coalesce(F.sum(F.length("match")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int")).drop("before")
    if most is not None:
        each = F.broadcast(each.orderBy(*order, "n").limit(most))  # at most so many rows
    first = F.greatest(F.lit(0), F.col("start") - context)
    around = F.substring("text", first + 1, F.col("start") - first + F.length("match") + context)
    out = segments.select(*order, "text").join(each, list(order)).select(*order, "n", "start", "match", F.trim(F.regexp_replace(around, r"(?U)\s+", " ")).alias("around"))
    return out if most is None else out.orderBy(*order, "n")


def postings(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Term, key, tf and positions of all texts; see ``write_index`` for what is stored."""
    each = chunks.select(key, F.posexplode(T.index_tokens("text")).alias("pos", "term"))
    return each.groupBy("term", key).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def doc_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.select(key, F.size(T.index_tokens("text")).alias("len"))
