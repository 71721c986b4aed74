"""Tables as the service reads them, documents as a producer builds them, and external boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lectern.functions import text as T
from lectern.functions import urls as U

KINDS = ("inline", "html", "file", "external")
DOCUMENT = "site_id string, doc_id string, course_id int, section_id int, section_order int, section_name string, cmid int, modname string, module_name string, title string, kind string, header_path array<string>, module_url string, external_url string, text string, timemodified long, file struct<sha256:string,filename:string,mimetype:string,filesize:long>, content_hash string, placement_hash string"
MOST_ROWS = 500


def read_documents(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Pushed documents from JSON lines or Parquet, with the schema of a document."""
    return spark.read.schema(DOCUMENT).format(form).load(path)


def bounded_request(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """One request's rows; more than ``most`` are an error when they are read. No more than one row above that is counted."""
    if len(rows.select(F.lit(1)).limit(most + 1).collect()) > most:
        raise ValueError(f"a request has at most {most} documents")
    return rows


def unwrapped(spark: SparkSession, path: str, field: str = "documents") -> DataFrame:
    """Documents of JSON files that are lines, an array, or an object with them in ``field``."""
    schema = spark.createDataFrame([], DOCUMENT).schema
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    bare = F.from_json("v", ArrayType(schema))
    wrapped = F.from_json("v", StructType([StructField(field, ArrayType(schema))]))[field]
    lines = F.transform(F.filter(F.split("v", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, schema))
    return text.select(F.explode(F.when(F.col("v").startswith("["), bare).when(wrapped.isNotNull(), wrapped).otherwise(lines)).alias("d")).select("d.*")


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """Pushed documents as a stream of JSON files."""
    return spark.readStream.schema(DOCUMENT).json(path)


def invalid_documents(docs: DataFrame) -> DataFrame:
    """Documents that break their kind's rule: doc_id and reason."""
    kind = F.col("kind")
    reason = (
        F.when(~kind.isin(*KINDS) | kind.isNull(), "unknown kind")
        .when((kind == "file") & F.col("file").isNull(), "a file needs file")
        .when(kind.isin("inline", "html") & F.col("text").isNull(), "text is missing")
        .when((kind == "external") & F.col("external_url").isNull(), "external_url is missing")
        .when(~F.col("doc_id").rlike(r"^\d+:\d+:.+"), "doc_id is not course:cmid:part")
    )
    return docs.select("doc_id", reason.alias("reason")).where("reason IS NOT NULL")


def live_courses(courses: DataFrame, site_id: str, course_ids: list[int] | None = None) -> DataFrame:
    """Live courses in order of id; an empty list of ids gives none."""
    rows = courses.where((F.col("site_id") == site_id) & F.col("tombstoned_at").isNull())
    if course_ids is not None:
        rows = rows.where(F.col("course_id").isin(course_ids)) if course_ids else rows.where(F.lit(False))
    return rows.orderBy("course_id")


def live_documents(docs: DataFrame, site_id: str, course_ids: list[int] | None = None, cmids: DataFrame | None = None) -> DataFrame:
    rows = docs.where((F.col("site_id") == site_id) & F.col("tombstoned_at").isNull())
    if course_ids is not None:
        rows = rows.where(F.col("course_id").isin(course_ids)) if course_ids else rows.where(F.lit(False))
    if cmids is not None:
        rows = rows.join(cmids.select("cmid"), "cmid", "left_semi")
    return rows.orderBy("course_id", "section_order", "doc_id")


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the asked ids (key, pos), in the order asked; missing ones drop out."""
    return rows.join(ids, key).orderBy("pos")


def modules_to_documents(modules: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Documents of modules (course_id, cmid, modname, name, intro, content, url, chapters): a part per text.

    label and intro are inline, page and book chapters HTML, url external; ``files`` (cmid, path,
    sha256, filename) of resource and folder modules are a part each, named by their path.
    """
    base = ["course_id", "cmid", "modname", "name"]
    part = lambda cond, kind, part, text, url: modules.where(cond).select(*base, F.lit(kind).alias("kind"), part.alias("part"), text.alias("text"), url.alias("external_url"))
    none = F.lit(None).cast("string")
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    rows = part(has("intro"), "inline", F.lit("intro"), F.col("intro"), none)
    rows = rows.unionAll(part((F.col("modname") == "page") & has("content"), "html", F.lit("content"), F.col("content"), none))
    rows = rows.unionAll(part((F.col("modname") == "url") & has("url"), "external", F.lit("url"), none, F.col("url")))
    chapters = modules.where(F.col("modname") == "book").select(*base, F.posexplode("chapters").alias("n", "chapter"))
    rows = rows.unionAll(chapters.select(*base, F.lit("html").alias("kind"), F.concat(F.lit("chapter"), (F.col("n") + 1).cast("string")).alias("part"), F.col("chapter").alias("text"), none.alias("external_url")))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("text", "external_url"), 256))
    if files is not None:
        own = modules.where(F.col("modname").isin("resource", "folder")).select(*base).join(files, "cmid")
        rows = rows.unionByName(own.select(*base[:3], F.col("filename").alias("name"), F.lit("file").alias("kind"), F.concat(F.lit("file:"), "path", "filename").alias("part"), none.alias("text"), none.alias("external_url"), F.col("sha256").alias("digest")))
    ids = F.concat_ws(":", "course_id", "cmid", "part")
    return rows.select(ids.alias("doc_id"), *base[:3], T.clean_title("name").alias("title"), "kind", "text", "external_url", F.col("digest").alias("content_hash"))


def external_requests(docs: DataFrame) -> DataFrame:
    """What to fetch for external documents: doc_id, connector, fetch_url; connector null is a clean skip."""
    u = "external_url"
    kind = U.source_kind(u)
    fetch = F.when(kind == "hackmd", U.hackmd_export(u)).when(kind == "google", U.google_export(u)["url"]).when(kind == "nextcloud", U.share_download(u)).when(kind == "youtube", U.youtube_id(u)).when(kind == "taskcards", U.board_id(u))
    return docs.where("kind = 'external'").select("doc_id", kind.alias("connector"), fetch.alias("fetch_url"))


def transcript_choice(tracks: DataFrame) -> DataFrame:
    """Of the tracks (video_id, lang, text) the German one, else the English, else the first."""
    rank = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).otherwise(2)
    return tracks.groupBy("video_id").agg(F.min(F.struct(rank.alias("rank"), "lang", "text")).alias("t")).select("video_id", "t.lang", "t.text")


def render_board(boards: DataFrame, lists: DataFrame, cards: DataFrame) -> DataFrame:
    """Boards (board_id, name), lists (board_id, list_id, pos, name) and cards (board_id, list_id, pos, title, description) as text; unlisted cards last."""
    body = T.strip_html("description")
    line = F.concat(F.lit("- "), T.strip_html("title"), F.when(body != "", F.concat(F.lit(": "), body)).otherwise(F.lit("")))
    own = lists.select("board_id", "list_id", F.col("pos").alias("list_pos"), F.col("name").alias("list_name"))
    rows = cards.select("board_id", "list_id", "pos", line.alias("line")).join(own, ["board_id", "list_id"], "left")
    per = rows.groupBy("board_id", "list_pos", "list_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.when(F.col("list_name").isNotNull(), F.concat(F.lit("\n"), F.col("list_name"), F.lit(":\n"), F.col("lines"))).otherwise(F.col("lines"))
    parts = per.groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("list_pos", F.lit(2**31 - 1)).alias("at"), head.alias("text")))).alias("parts"))
    return boards.join(parts, "board_id", "left").select("board_id", F.concat_ws("\n", F.coalesce("name", F.lit("TaskCards-Board")), F.transform("parts", lambda p: p["text"])).alias("text"))


def resolve_refs(refs: DataFrame, courses: DataFrame, modules: DataFrame, visible: DataFrame, base: str) -> DataFrame:
    """URLs of references (kind, id): course, module or document; '' for what is not visible or unknown."""
    p = T.doc_id_parts("id")
    cmid = F.when(F.col("kind") == "document", p["cmid"]).when(F.col("kind") == "module", F.col("id").cast("int"))
    rows = refs.withColumns({"course_id": F.when(F.col("kind") == "course", F.col("id").cast("int")), "cmid": cmid})
    seen = modules.join(visible.select("cmid"), "cmid", "left_semi").select("cmid", F.col("modname").alias("m"))
    rows = rows.join(courses.where("tombstoned_at IS NULL").select("course_id", F.lit(True).alias("c")), "course_id", "left").join(seen, "cmid", "left")
    url = F.when(F.col("c").isNotNull(), F.concat(F.lit(f"{base}/course/view.php?id="), F.col("course_id").cast("string"))).when(F.col("m").isNotNull(), F.concat(F.lit(f"{base}/mod/"), F.col("m"), F.lit("/view.php?id="), F.col("cmid").cast("string")))
    return rows.select("kind", "id", F.coalesce(url, F.lit("")).alias("url"))


def capture_changes(events: DataFrame, allowlist: list[int]) -> DataFrame:
    """Platform events (course_id, cmid, event) as changes to send: upsert or delete, of included courses."""
    action = F.when(F.col("event").isin("module_created", "module_updated"), "upsert").when(F.col("event") == "module_deleted", "delete").when(F.col("event") == "course_deleted", "course_deleted").when(F.col("event").isin("course_updated", "course_created"), "upsert")
    rows = events.where(F.col("course_id").isin(allowlist)) if allowlist else events
    return rows.withColumn("action", action).where("action IS NOT NULL")
