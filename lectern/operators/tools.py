"""The tools: named queries with checked arguments over one corpus, each giving a DataFrame."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.moments import format_date, moment
from lectern.operators import scope, search, store, tree

NO_HITS = "Keine Treffer."
MAX_CHARS, READ_CHARS = 6000, 20_000


@dataclass
class Corpus:
    """What tools read: documents (doc_id, text, timemodified, cmid, ...), paths, and the permissions."""

    documents: DataFrame
    paths: DataFrame | None = None
    segments: DataFrame | None = None
    vectors: DataFrame | None = None
    embed: Callable[[str], Column] | None = None
    allowed: DataFrame | None = None
    acl: DataFrame | None = None
    now: datetime = field(default_factory=lambda: datetime.now().astimezone())
    capabilities: frozenset[str] = frozenset()
    #: Ranks by a stored index instead of a scan, for example ``live_index.ranking(snapshot)``.
    index: search.Ranking | None = None

    def scoped(self, path: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        """Documents in scope, below a path and within days (both inclusive)."""
        lo, hi = (None if not (told or "").strip() else moment(F.lit(told), F.lit(int(self.now.timestamp())), self.zone, late) for told, late in ((since, False), (until, True)))
        ids = None
        if path and path.strip("/") and self.paths is not None:
            ids = scope.under(self.paths, tree.resolve(self.paths, path)).select("doc_id")
        return scope.in_scope(self.documents, cmids=self.allowed, doc_ids=ids, since=lo, until=hi)

    @property
    def zone(self) -> str:
        """The name of the time zone of ``now``, or its distance from UTC."""
        return getattr(self.now.tzinfo, "key", None) or self.now.strftime("%z")[:3] + ":" + self.now.strftime("%z")[3:5]

    def live(self, docs: DataFrame) -> DataFrame:
        return docs if self.acl is None else scope.readable(docs, self.acl)


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    requires: frozenset[str] = frozenset()

    def arguments(self) -> dict[str, inspect.Parameter]:
        return dict(list(inspect.signature(self.run).parameters.items())[1:])


class Registry:
    """Tools by name; each name once."""

    def __init__(self):
        self.tools: dict[str, Tool] = {}

    def register(self, name: str, run: Callable[..., DataFrame], requires: Iterable[str] = ()) -> Tool:
        if name in self.tools:
            raise ValueError(f"{name} is taken")
        self.tools[name] = Tool(name, run, frozenset(requires))
        return self.tools[name]

    def available(self, capabilities: Iterable[str], disabled: Iterable[str] = ()) -> list[str]:
        held, off = set(capabilities), set(disabled)
        return [n for n, t in self.tools.items() if t.requires <= held and n not in off]

    def call(self, name: str, corpus: Corpus, **arguments) -> DataFrame:
        tool = self.tools.get(name)
        if tool is None or not tool.requires <= corpus.capabilities:
            raise LookupError(f"no tool {name}")
        if unknown := set(arguments) - set(tool.arguments()):
            raise TypeError(f"{name} has no {', '.join(sorted(unknown))}")
        return tool.run(corpus, **arguments)


def bounded(value: int, least: int, most: int, name: str) -> int:
    if not least <= value <= most:
        raise ValueError(f"{name} is {least} to {most}")
    return value


def search_content(c: Corpus, query: str, k: int = 8, path: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Hybrid search; k is applied before the live check, so fewer may be left."""
    bounded(k, 1, 20, "k")
    docs = c.scoped(path, since, until)
    vector = c.embed(query) if c.embed and c.vectors is not None else None
    hits = search.hybrid(c.documents, c.vectors, query, vector, k, scope=docs.select("doc_id"), index=c.index)
    return c.live(search.hydrate(hits, docs)).orderBy(F.desc("score"), "doc_id")


def search_text(c: Corpus, query: str, mode: str = "any", k: int = 8, path: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    bounded(k, 1, 20, "k")
    if mode not in ("any", "all", "phrase"):
        raise ValueError("mode is any, all or phrase")
    docs = c.scoped(path, since, until)
    return c.live(search.hydrate(search.text_search(c.documents, query, k, mode, docs.select("doc_id"), c.index), docs)).orderBy("rank")


def search_regex(c: Corpus, pattern: str, path: str | None = None, ignore_case: bool = False, max_matches: int = 20, context_chars: int = 120, since: str | None = None, until: str | None = None) -> DataFrame:
    """The live check comes before the limit here."""
    bounded(max_matches, 1, 50, "max_matches"), bounded(context_chars, 0, 400, "context_chars")
    return search.regex_matches(c.live(c.scoped(path, since, until)), pattern, ignore_case, context_chars, most=max_matches)


def list_dir(c: Corpus, path: str = "/") -> DataFrame:
    """Children of a folder: name, n (of the tree), modified; files that the live check denies drop out."""
    at = tree.resolve(c.paths, path)
    depth = len([p for p in at.split("/") if p])
    rows = scope.under(c.paths, at).join(c.scoped().select("doc_id", "timemodified"), "doc_id")
    parts = F.split("path", "/")
    rows = rows.withColumns({"name": F.get(parts, F.lit(depth + 1)), "file": F.size(parts) == depth + 2}).where("name IS NOT NULL")
    if c.acl is not None:
        rows = rows.where(~F.col("file")).unionByName(scope.readable(rows.where("file"), c.acl))
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.max("timemodified").alias("modified"), F.bool_or("file").alias("file")).orderBy("name")


def _one(c: Corpus, path: str) -> DataFrame:
    at = tree.resolve(c.paths, path)
    return c.live(c.scoped().join(c.paths.where(F.col("path") == at).select("doc_id", "path"), "doc_id"))


def stat_file(c: Corpus, path: str) -> DataFrame:
    """What is known of a file; title, kind, link and a note where the documents have them."""
    rows = _one(c, path)
    has = lambda n: F.col(n) if n in rows.columns else F.lit(None).cast("string")
    kind = store.labelled(has("kind"), store.KINDS)
    kind = F.when(has("mimetype").isNotNull(), F.concat(kind, F.lit(" ("), has("mimetype"), F.lit(")"))).otherwise(kind)
    note = F.when(has("skip_reason").isNotNull(), F.concat(F.lit("Inhalt nicht (vollständig) lesbar ("), has("skip_reason"), F.lit(")")))
    return rows.select("doc_id", "path", has("title").alias("title"), kind.alias("kind"), F.length("text").alias("chars"), T.token_estimate("text").alias("tokens"), format_date(F.col("timemodified"), c.zone).alias("modified"), has("module_url").alias("link"), note.alias("note"))


def read_file(c: Corpus, path: str, offset: int = 0, limit: int = 6000, page: int | None = None) -> DataFrame:
    """A part of a file's text, in which each page begins with its mark, and where the next part begins."""
    bounded(limit, 1, READ_CHARS, "limit")
    rows = _one(c, path).select("doc_id", "text")
    if c.segments is None:
        segments = rows.withColumns({"ordinal": F.lit(0), "page": F.lit(None).cast("int")})
    else:
        segments = c.segments.join(rows.select("doc_id"), "doc_id", "left_semi")
    mark = F.when(F.col("page") > 0, F.concat(F.lit("[Seite "), F.col("page").cast("string"), F.lit("]\n"))).otherwise(F.lit(""))
    return tree.read_segments(segments.withColumn("text", F.concat(mark, "text")), offset, limit, page)


def list_documents(c: Corpus, order: str = "newest", path: str | None = None, limit: int = 20, since: str | None = None, until: str | None = None) -> DataFrame:
    bounded(limit, 1, 100, "limit")
    return tree.list_documents(c.scoped(path, since, until), order == "newest", limit, c.acl)


def current_datetime(c: Corpus) -> DataFrame:
    spark, at = c.documents.sparkSession, c.now
    return spark.range(1).select(F.lit(at.isoformat()).alias("now"), F.lit(f"{at.isocalendar().year}-W{at.isocalendar().week:02d}").alias("iso_week"), F.lit(at.isoweekday()).alias("weekday"), F.lit(str(at.tzinfo)).alias("zone"))


def current_user(c: Corpus, roles: DataFrame, teacher: tuple[str, ...] = ("teacher", "editingteacher", "manager"), detail: str = "summary", groups: DataFrame | None = None) -> DataFrame:
    """Of each user of roles (user_id, course_id, roles): how many courses, and those taught (summary); or, for courses and access, a row per course with what its roles are called and the user's groups (user_id, course_id, group)."""
    if detail not in ("summary", "courses", "access"):
        raise ValueError("detail is summary, courses or access")
    if detail == "summary":
        return roles.groupBy("user_id").agg(F.count("*").alias("courses"), F.count_if(F.arrays_overlap("roles", F.array(*map(F.lit, teacher)))).alias("taught"))
    named = roles.select("user_id", "course_id", F.coalesce(F.nullif(F.array_join(F.transform("roles", lambda r: store.labelled(r, store.ROLES)), ", "), F.lit("")), F.lit("—")).alias("roles"))
    if groups is None:
        return named.withColumn("groups", F.lit(""))
    own = groups.groupBy("user_id", "course_id").agg(F.array_join(F.array_sort(F.collect_set("group")), ", ").alias("groups"))
    return named.join(own, ["user_id", "course_id"], "left").withColumn("groups", F.coalesce("groups", F.lit("")))


def standard() -> Registry:
    r = Registry()
    for f in (search_content, search_text, search_regex, list_dir, stat_file, read_file, list_documents, current_datetime, current_user):
        r.register(f.__name__, f)
    return r


def rendered(hits: DataFrame, most: int = MAX_CHARS) -> str:
    """Few hits (n, path, page, timemodified, snippet) as text, cut to a length; NO_HITS for none."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(", S. "), F.col("page").cast("string"))).otherwise(F.lit(""))
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "path", page, F.lit(" · geändert "), format_date(F.col("timemodified")), F.lit("\n"), "snippet")
    text = "\n\n".join(r[0] for r in hits.orderBy("n").select(line).collect())
    return NO_HITS if not text else text if len(text) <= most else text[:most] + "\n… gekürzt"


def checked_question(question: str, options: list[str] = (), multi: bool = False) -> dict:
    """A question to a user: up to eight distinct options; several answers only with options."""
    if not question.strip() or len(options) > 8 or len(set(options)) != len(options) or (multi and not options):
        raise ValueError("a question needs text and at most eight different options")
    return {"question": question, "options": list(options), "multi": multi}


def valid_answers(question: Column, options: Column, multi: Column, answer: Column) -> Column:
    """Whether answers (an array) fit a question's options."""
    free = F.size(options) == 0
    return F.when(free, F.size(answer) == 1).otherwise((F.size(F.array_except(answer, options)) == 0) & (F.size(answer) >= 1) & (multi | (F.size(answer) == 1)))
