"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import documents, fold


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.image_copies import image_copies, thumbnails

    copies = image_copies(thumbnails(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return copies.withColumnRenamed("id", "page_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lectern.llm.toxicity import tagged, trained

    docs, held_out = documents(spark, sf_dir), fold("doc_id", 3) == 1
    model = trained(docs, labels(spark, sf_dir), ~held_out)
    scored = tagged(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.to_json("spans").alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lectern.llm.quality import scored_by_labels

    held_out = fold("doc_id", 5) == 0
    return scored_by_labels(documents(spark, sf_dir), labels(spark, sf_dir), ~held_out).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.packing import packed

    return packed(documents(spark, sf_dir), vocabulary(), room=1024, end=2)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.token_files import round_trip

    return round_trip(documents(spark, sf_dir), vocabulary(), end=0)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lectern.llm.simhash_dedup import near_groups

    return near_groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.token_count import token_counts

    return token_counts(documents(spark, sf_dir), vocabulary(), limit=1024)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lectern.llm.line_dedup import line_dedup

    left = line_dedup(documents(spark, sf_dir))
    return left.select("doc_id", "lines", "kept", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lectern.llm.merkle import manifest

    # A row without an id, which crc32 would give 0, is not tampered with.
    changed = F.col("doc_id").isNotNull() & (fold("doc_id", 7) == 0)
    return manifest(documents(spark, sf_dir), changed, {"n_chars": F.col("n_chars") + 1})


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.resampling import resampled

    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=10, least=20, seed=2024, most=1, buckets=10_000)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.html_main import main_text

    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_image_copies, op2_toxicity, op3_quality, op4_source_mixing, op5_best_fit_packing, op6_token_files, op7_simhash_dedup, op8_token_counts, op9_line_dedup, op10_exact_dedup, op11_merkle_manifest, op12_importance_resampling, op13_main_text)}


#: crc32 (unsigned) of distinct texts ``x`` of ``words``, in SQL: the polynomial's table by its rule, then byte by byte.
_CRC32 = """
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(0, 256) r(i))),
    crc AS (SELECT x, xor(4294967295, list_reduce(
        list_transform(range(0, octet_length(encode(x))), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295)) AS crc
        FROM (SELECT DISTINCT x FROM words), crc_table)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_merkle_manifest": f"""
            WITH RECURSIVE words AS (SELECT coalesce(doc_id::VARCHAR, '') AS x FROM documents), {_CRC32},
            docs AS (SELECT d.*, doc_id IS NOT NULL AND crc % 7 = 0 AS changed,
                            concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
                            coalesce(strlen(text) || ':' || text, '-') AS tail
                     FROM documents d JOIN crc ON x = coalesce(doc_id::VARCHAR, '')),
            leaves AS (SELECT doc_id, lang, changed, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                              sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS other FROM docs),
            placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
            low(lang, k, nodes) AS (
                SELECT lang, 0, list(leaf ORDER BY place) FROM placed GROUP BY lang
                UNION ALL
                SELECT lang, k + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM low WHERE len(nodes) > 1),
            subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE len(nodes) = 1),
            high(k, nodes) AS (
                SELECT 0, list(subroot ORDER BY place) FROM subroots
                UNION ALL
                SELECT k + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM high WHERE len(nodes) > 1),
            steps AS (
                SELECT p.lang, p.place, p.doc_id, k, nodes[xor(p.place >> k, 1) + 1] AS sibling, (p.place >> k) % 2 AS side FROM placed p JOIN low l ON p.lang IS NOT DISTINCT FROM l.lang WHERE len(nodes) > 1
                UNION ALL
                SELECT p.lang, p.place, p.doc_id, 1000 + k, nodes[xor(s.place >> k, 1) + 1], (s.place >> k) % 2 FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang, high WHERE len(nodes) > 1),
            paths AS (SELECT lang, place, string_agg(coalesce(sibling, ''), '' ORDER BY k) AS siblings,
                             list(CASE WHEN side = 1 THEN 'L' ELSE 'R' END || coalesce(sibling, '') ORDER BY k) AS path FROM steps GROUP BY lang, place),
            top AS (SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1),
            folded AS (SELECT p.doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
                              list_reduce(coalesce(path, []), lambda h, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || h ELSE h || s[2:] END), CASE WHEN changed THEN other ELSE leaf END) AS folded_root
                       FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths q ON q.place = p.place AND q.lang IS NOT DISTINCT FROM p.lang, top)
            SELECT *, folded_root = root AS verified FROM folded""",
        "op12_importance_resampling": f"""
            WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
            aim AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
            words AS (SELECT DISTINCT unnest(w) AS x FROM cut UNION SELECT DISTINCT unnest(w) FROM aim), {_CRC32},
            bucket AS (SELECT x, crc % 10000 AS b FROM crc),
            source AS (SELECT b, count(*) AS s FROM (SELECT unnest(w) AS x FROM cut) JOIN bucket USING (x) GROUP BY b),
            target AS (SELECT b, count(*) AS t FROM (SELECT unnest(w) AS x FROM aim) JOIN bucket USING (x) GROUP BY b),
            sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM source)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS big_t),
            gains AS (SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + 10000) / ((s::DOUBLE + 1) * (big_t + 10000))))::BIGINT AS gain FROM source LEFT JOIN target USING (b), sums),
            weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(w) AS x FROM cut) JOIN bucket USING (x) JOIN gains USING (b) GROUP BY doc_id),
            scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                              coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM cut LEFT JOIN weights USING (doc_id)),
            able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
            SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN able USING (doc_id)""",
        # For the markup of these tables: one article a page, of headings, paragraphs and breaks.
        "op13_main_text": r"""
            WITH cut AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS a FROM pages),
            plain AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '\s+', ' ', 'g'), '</?(h1|p|br)\b[^>]*>', chr(10), 'g') AS a FROM cut),
            decoded AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(a, '<[^>]*>', '', 'g'), '&quot;', '"', 'g'), '&amp;?', '&', 'g') AS a FROM plain),
            texts AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(a, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM decoded)
            SELECT page_id, url, text, length(text) AS n_chars FROM texts""",
        "op10_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    }
