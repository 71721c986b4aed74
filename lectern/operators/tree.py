"""The folder view: course, section, module, file, as path columns instead of a graph."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


def unique_names(df: DataFrame, parent: list[str], name: str, order: list[str], out: str) -> DataFrame:
    """Siblings of one name become "x", "x (2)", "x (3)" in order, each the first of these that no sibling before it has.

    Numbers come from a window over siblings of one name. Only where a name as it is looks like a numbered
    one are names settled one after the other: those of one parent that are alike but for such numbers,
    as no others can meet.
    """
    n = F.row_number().over(Window.partitionBy(*parent, name).orderBy(*order))
    rows = df.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))))
    rows = rows.withColumn("base", F.regexp_replace(name, r"( \(\d+\))+$", ""))
    # Seldom any: adaptive execution then drops the join.
    clash = rows.where(F.col("base") != F.col(name)).select(*parent, "base", F.lit(True).alias("clash")).distinct()
    rows = rows.join(clash, [*parent, "base"], "left").select(*df.columns, out, "base", "clash")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("clash", "base").schema)

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        part[out] = settle_names(part[name].tolist())
        return part.drop(columns=["clash", "base"])

    settled = rows.where("clash").groupBy(*parent, "base").applyInPandas(settle, kind)
    return rows.where("clash IS NULL").drop("clash", "base").unionByName(settled)


def settle_names(names: list[str]) -> list[str]:
    """Names of siblings in order, each the first of "x", "x (2)", ... that is still free."""
    taken: set[str] = set()
    out = []
    for name in names:
        n, own = 2, name
        while own in taken:
            own, n = f"{name} ({n})", n + 1
        taken.add(own)
        out.append(own)
    return out


def tree_paths(docs: DataFrame, courses: DataFrame, course_ids: list[int] | None = None) -> DataFrame:
    """One row per live document: doc_id, course_path, section_path, module_path, path, and is_module (the module is the file)."""
    rows = docs if course_ids is None else docs.where(F.col("course_id").isin(list(course_ids)))
    rows = rows.where("tombstoned_at IS NULL") if "tombstoned_at" in rows.columns else rows
    if course_ids is not None:
        courses = courses.where(F.col("course_id").isin(list(course_ids)))
    named = courses.select("course_id", T.path_name("fullname", F.concat(F.lit("Kurs "), F.col("course_id").cast("string"))).alias("course_clean"))
    named = unique_names(named, [], "course_clean", ["course_id"], "course_name")
    # A module is placed by its first document.
    place = F.struct("section_order", "section_id", "doc_id")
    module = Window.partitionBy("course_id", "cmid")
    first = F.min(F.struct(place.alias("at"), F.struct("section_name", F.coalesce(F.nullif("module_name", F.lit("")), F.col("title")).alias("module")).alias("of"))).over(module)
    rows = rows.withColumns({"first": first, "files": F.count("*").over(module)})
    modules = rows.select("course_id", "cmid", "files", F.col("first.at.section_order").alias("s_order"), F.col("first.at.section_id").alias("s_id"), F.col("first.at.doc_id").alias("s_doc"), F.col("first.of.section_name").alias("s_raw"), F.col("first.of.module").alias("m_raw")).distinct()
    sections = modules.groupBy("course_id", "s_id", "s_order").agg(F.min(F.struct("s_doc", "s_raw"))["s_raw"].alias("s_raw"))
    sections = sections.withColumn("s_clean", T.path_name("s_raw", F.concat(F.lit("Abschnitt "), F.col("s_order").cast("string"))))
    sections = unique_names(sections, ["course_id"], "s_clean", ["s_order", "s_id"], "section")
    modules = modules.join(sections.select("course_id", "s_id", "s_order", "section"), ["course_id", "s_id", "s_order"])
    modules = unique_names(modules.withColumn("m_clean", T.path_name("m_raw", F.lit("Inhalt"))), ["course_id", "s_id", "s_order"], "m_clean", ["s_doc"], "module")
    files = rows.select("course_id", "cmid", "doc_id", T.path_name("title", F.col("doc_id").cast("string")).alias("f_clean"), "section_order", "section_id")
    files = unique_names(files, ["course_id", "cmid"], "f_clean", ["section_order", "section_id", "doc_id"], "file")
    all_ = files.join(modules.select("course_id", "cmid", "files", "section", "module"), ["course_id", "cmid"]).join(named.select("course_id", "course_name"), "course_id", "left")
    course = F.concat(F.lit("/"), F.coalesce("course_name", F.concat(F.lit("Kurs "), F.col("course_id").cast("string"))))
    section = F.concat_ws("/", course, "section")
    module_path = F.concat_ws("/", section, "module")
    return all_.select("doc_id", course.alias("course_path"), section.alias("section_path"), module_path.alias("module_path"), F.when(F.col("files") == 1, module_path).otherwise(F.concat_ws("/", module_path, "file")).alias("path"), (F.col("files") == 1).alias("is_module"))


def subtree(df: DataFrame, levels: list[str], modified: str) -> DataFrame:
    """Documents and latest change of every node of all levels: the levels (null below), n, modified."""
    sums = df.rollup(*levels).agg(F.count("*").alias("n"), F.max(modified).alias("modified"), F.grouping_id().alias("g"))
    return sums.where(F.col("g") < (1 << len(levels)) - 1).drop("g")


def children(df: DataFrame, parent: str, child: str, modified: str) -> DataFrame:
    """What a folder lists: each child with its number of documents and latest change."""
    return df.groupBy(parent, child).agg(F.count("*").alias("n"), F.max(modified).alias("modified"))


def location(path: Column) -> Column:
    """The steps from the root to a node: array of struct(depth, name)."""
    return F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p, i: F.struct((i + 1).alias("depth"), p.alias("name")))


#: How like a name must be to be taken for another, and to be suggested.
LIKE, NEAR = 0.75, 0.4


def likeness(name: Column, wanted: str, least: float) -> Column:
    """The share of letters in matching blocks of both, by batches; 0 below ``least``, which counts of letters tell first."""

    def of(names: pd.Series) -> pd.Series:
        pair = difflib.SequenceMatcher()
        pair.set_seq2(wanted)

        def one(n: str) -> float:
            pair.set_seq1(n)
            # Two upper bounds, by the lengths and by the letters in common.
            return pair.ratio() if pair.real_quick_ratio() >= least and pair.quick_ratio() >= least and pair.ratio() >= least else 0.0

        return names.map(one)

    return F.pandas_udf(of, "double")(name)


def similar_name(names: DataFrame, wanted: str) -> tuple[str | None, list[str]]:
    """The only one of ``names`` (n) that is like a wanted one but for case, or None and up to three suggestions, the first five names where nothing is near.

    All names are compared, where they are; at most five rows come back.
    """
    fold = F.pandas_udf(lambda n: n.str.casefold(), "string")
    near = names.select("n", fold("n").alias("folded")).groupBy("folded").agg(F.max("n").alias("n")).withColumn("score", likeness(F.col("folded"), wanted.casefold(), LIKE))
    like = near.where("score > 0").orderBy(F.desc("score"), F.desc("folded")).limit(2).collect()
    if len(like) == 1:
        return like[0]["n"], []
    said = names.withColumn("score", likeness(F.col("n"), wanted, NEAR)).where("score > 0").orderBy(F.desc("score"), F.desc("n")).limit(3).collect()
    return None, [r["n"] for r in said or names.orderBy("n").limit(5).collect()]


def resolve(paths: DataFrame, path: str) -> str:
    """The full path that a user's path means, level by level: the same name, else the same but for case, else the only one it begins, else the only similar one.

    All but the last are one filtered query of at most three rows; for the last all names of the folder
    are compared, on the executors.
    """
    at = ""
    for depth, wanted in enumerate([p.strip() for p in (path or "/").split("/") if p.strip()], start=1):
        below = paths if not at else paths.where(F.col("path").startswith(at + "/"))
        level = below.select(F.get(F.split("path", "/"), F.lit(depth)).alias("n")).where("n IS NOT NULL").distinct()
        low = wanted.lower()
        rank = F.when(F.col("n") == wanted, 0).when(F.lower("n") == low, 1).when(F.lower("n").startswith(low), 2)
        hits = level.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "n").limit(3).collect()
        sure = [r.n for r in hits if r["rank"] < 2][:1] or [r.n for r in hits]
        near: list[str] = []
        if len(sure) == 1:
            found = sure[0]
        else:
            found, near = similar_name(level, wanted)
        if found is None:
            raise LookupError(f"no {wanted!r} in {at or '/'}; perhaps {', '.join(near) or 'nothing there'}")
        at = f"{at}/{found}"
    return at or "/"


def read_segments(segments: DataFrame, offset: int = 0, limit: int = 6000, page: int | None = None) -> DataFrame:
    """One row per document: text (a part of its segments joined by blank lines), page, next_offset.

    Page is that of the last segment that begins at or before the offset. Only segments that reach into
    the part are put together.
    """
    rows = segments if page is None else segments.where(F.col("page") == page)
    by = Window.partitionBy("doc_id").orderBy("ordinal")
    rows = rows.withColumns({"start": F.coalesce(F.sum(F.length("text") + 2).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "last": F.lead("ordinal").over(by).isNull()})
    end = F.col("start") + F.length("text")
    reaches = (end + 2 > offset) & (F.col("start") < offset + limit)
    own = rows.select("doc_id", "ordinal", "page", "start", end.alias("end"), "last", F.when(reaches, F.concat("text", F.when(F.col("last"), F.lit("")).otherwise(F.lit("\n\n")))).alias("text"))
    at = F.when(F.col("start") <= offset, F.col("start"))
    got = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ordinal", "start", "text")))).alias("s"), F.max("end").alias("size"), F.max_by(F.when(F.col("start") <= offset, F.col("page")), at).alias("page"))
    whole, first = F.array_join(F.transform("s", lambda x: x["text"]), ""), F.coalesce(F.get("s", F.lit(0))["start"], F.lit(0))
    return got.select("doc_id", F.substring(whole, (F.lit(offset + 1) - first).cast("int"), F.lit(limit)).alias("text"), "page", F.when(F.col("size") > offset + limit, F.lit(offset + limit)).alias("next_offset"))


def list_documents(docs: DataFrame, newest: bool = True, limit: int = 20, acl: DataFrame | None = None, modified: str = "timemodified") -> DataFrame:
    """By change and id, both reversed for newest; permissions come before the limit."""
    rows = docs if acl is None else docs.join(acl.select("doc_id"), "doc_id", "left_semi")
    order = [F.col(modified), F.col("doc_id")]
    return rows.orderBy(*((o.desc() if newest else o.asc()) for o in order)).limit(max(1, min(100, limit)))


def access_trap(modules: DataFrame) -> DataFrame:
    """Dataset rule: of every second course the last module is hidden, of the others the last section restricted."""
    last = F.row_number().over(Window.partitionBy("course_id").orderBy(F.desc("position"), F.desc("cmid"))) == 1
    # Courses are few beside their modules; only their distinct ids pass through one window.
    every = modules.select("course_id").distinct().withColumn("index", F.row_number().over(Window.orderBy("course_id")) - 1)
    kind = F.when(F.col("index") % 2 == 0, F.lit("hidden")).otherwise(F.lit("restricted"))
    return modules.withColumn("last", last).join(every, "course_id").withColumn("trap", F.when(F.col("last"), kind)).drop("last", "index")
