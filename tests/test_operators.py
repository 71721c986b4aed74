"""Operators of retrieval, sync, jobs, logs and chunks on hand-made rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, embedding, events, jobs, outbox, scope, search, store, sync, tools, tree
from lectern.sources import connectors, formats


@pytest.fixture(scope="module")
def world(spark):
    rows = [(1, "Die Domänen und Netze", 10, 100), (2, "Netz aus Netzen, 802.1Q erklärt", 11, 200), (3, "Ganz anderes Thema", 12, 300), (4, "Netze verborgen", 13, 400)]
    return spark.createDataFrame(rows, "doc_id long, text string, cmid int, timemodified long")


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_search_modes(world):
    assert set(ids(search.bm25(world, "Domanen"))) == {1}
    assert set(ids(search.bm25(world, "netz"))) == {1, 2, 4}
    assert ids(search.bm25(world, "netz aus", "phrase")) == [2] and ids(search.bm25(world, "aus netz", "phrase")) == []
    assert ids(search.bm25(world, "802.1Q")) == [2]
    assert ids(search.bm25(world, "die netze", "all")) == [1]
    for odd in ('"', "NEAR(", "a AND", "*", "", "-- ;"):
        search.bm25(world, odd).collect()


def test_scope_never_ranks_hidden_rows(world):
    seen = world.where("cmid <> 13").select("doc_id")
    assert set(ids(search.text_search(world, "netze", 1, scope=seen))) <= {1, 2}
    assert ids(scope.in_scope(world, cmids=[])) == [] and ids(scope.in_scope(world, cmids=[10], since=100, until=100)) == [1]
    with pytest.raises(PermissionError):
        scope.readable(world, None)


def test_scope_is_below_the_limit_in_the_plan(world):
    plan = search.top(search.bm25(world, "netze", scope=world.select("doc_id")), "score", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Limit") < plan.index("LeftSemi")


def test_fusion_prefers_agreement(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "doc_id long, rank int")
    got = {r.doc_id: (r.score, r.sources) for r in search.fuse({"text": a, "vector": b}).collect()}
    assert max(got, key=lambda d: got[d][0]) == 2 and got[2][1] == "text,vector"


@pytest.mark.parametrize("bad", ["(a+)+$", "(.*)*x", "x" * 300, "([unclosed", ""])
def test_patterns_are_checked(bad):
    with pytest.raises(Exception):  # noqa: B017  ValueError or re.error
        search.checked_pattern(bad)


def test_regex_context(spark):
    df = spark.createDataFrame([(1, "am 01.02.2026 und 03.04.2026.")], "doc_id long, text string")
    got = search.regex_matches(df, r"\d\d\.\d\d\.\d{4}", context=3).collect()
    assert [(r.start, r.match) for r in got] == [(3, "01.02.2026"), (18, "03.04.2026")] and got[0].around == "am 01.02.2026 un"


def test_chunks():
    sentence = "Dies ist ein Satz mit einigen Wörtern darin. "
    got = chunking.structural([(sentence * 60, 1)])
    assert len(got) > 1 and all(len(b) <= 1200 for b, _ in got) and all(b.split(" ")[0] in sentence.split() for b, _ in got)
    assert [len(b) for b, _ in chunking.structural([("x" * 2000, 1)])] == [2000, 180] and chunking.structural([("x" * 2000, 1)], overlap=0) == [("x" * 2000, 1)]
    assert chunking.structural([("kurz", 1), ("auch kurz", 2)]) == [("kurz\n\nauch kurz", 1)]
    assert chunking.structural([(" ", 1)]) == []
    parts = "\n\n".join("a" * 500 for _ in range(6))
    assert all(set(b) <= {"a", "\n", " "} for b, _ in chunking.structural([(parts, None)]))


def failing(_texts):
    raise embedding.EmbeddingFailed


def test_semantic_chunks(spark):
    """Two subjects part; a document without all vectors is cut by structure; a single sentence stays."""
    schema = "doc_id long, ordinal int, text string, page int"
    segments = spark.createDataFrame([(1, 0, "Katze eins. Katze zwei.", 1), (1, 1, "Hund eins. Hund zwei.", 2), (2, 0, "Katze eins. Was sonst?", 5), (3, 0, "Nur das.", None), (4, 0, None, 1)], schema)
    vectors = chunking.sentences(segments).where("sentence NOT LIKE 'Was%'").selectExpr("lookup", "CASE WHEN sentence LIKE 'Katze%' THEN array(1.0D, 0.0D) ELSE array(0.0D, 1.0D) END AS vector")

    def cut(**told):
        return sorted((r["doc_id"], r["ordinal"], r["page"], r["body"]) for r in chunking.semantic(segments, vectors, **told).collect())

    assert cut(amount=60) == [(1, 0, 1, "Katze eins. Katze zwei."), (1, 1, 2, "Hund eins. Hund zwei."), (2, 0, 5, "Katze eins. Was sonst?"), (3, 0, None, "Nur das.")]
    assert [b for d, *_, b in cut(kind="gradient", target=5, overlap=0) if d == 1] == ["Katze eins.", "Katze zwei.", "Hund eins.", "Hund zwei."]


def test_semantic_chunks_cut_each_text_once(spark):
    """Given its sentences, the plan reads no text again; without gaps in the vectors there is no second cut of whole documents."""
    segments = spark.createDataFrame([(1, 0, "Katze eins. Katze zwei.\n\n\u2003Hund eins. Hund zwei.\u00a0", 1)], "doc_id long, ordinal int, text string, page int")
    cut = chunking.written(chunking.sentences(segments), "sentences")
    assert [r["sentence"] for r in cut.orderBy("pos").collect()] == ["Katze eins.", "Katze zwei.", "Hund eins.", "Hund zwei."]
    vectors = cut.selectExpr("lookup", "CASE WHEN sentence LIKE 'Katze%' THEN array(1.0D, 0.0D) ELSE array(0.0D, 1.0D) END AS vector")
    got = chunking.semantic(segments, vectors, cut=cut)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "MapInPandas" not in plan
    assert sorted((r["ordinal"], r["body"]) for r in got.collect()) == [(0, "Katze eins. Katze zwei."), (1, "Hund eins. Hund zwei.")]


@pytest.mark.parametrize("kind,amount,want", [("percentile", 90, 8.4), ("standard_deviation", 1, round(13 / 3 + (((1 - 13 / 3) ** 2 + (2 - 13 / 3) ** 2 + (10 - 13 / 3) ** 2) / 3) ** 0.5, 5)), ("interquartile", 1, 19), ("gradient", 0, 4.5)])
def test_thresholds(spark, kind, amount, want):
    rows = spark.createDataFrame([(1, i, float(d)) for i, d in enumerate((1, 2, 10))], "doc_id long, pos int, distance double")
    assert chunking.thresholds(rows, ["doc_id"], "pos", amount, amount).first()[chunking.KINDS[kind]] == want


def test_similar_names_are_those_of_all_pairs(spark):
    """As the library tells of a whole list: the only like one but for case, else up to three suggestions."""
    import difflib
    import random

    draw = random.Random(5)
    names = sorted({"".join(draw.choice("abcdeÄß ") for _ in range(draw.randint(1, 9))) for _ in range(300)} | {"Einführung", "EINFÜHRUNG", "Straße"})
    table = spark.createDataFrame([(n,) for n in names], "n string")
    for wanted in ("Einfuhrung", "STRASSE", "abcde", "qqqqqqqq", names[7][::-1]):
        by_case = {n.casefold(): n for n in names}
        near = difflib.get_close_matches(wanted.casefold(), list(by_case), n=2, cutoff=0.75)
        plain = (by_case[near[0]], []) if len(near) == 1 else (None, difflib.get_close_matches(wanted, names, n=3, cutoff=0.4) or names[:5])
        assert tree.similar_name(table, wanted) == plain, wanted


def test_tails():
    assert [chunking.tail("one two three", n) for n in (3, 7, 8, 99)] == ["ree", "three", "three", "one two three"]


def test_chunk_documents_spans_pages(spark):
    rows = [(1, 0, "eins " * 200, 1, ["K", "M"]), (1, 1, "zwei " * 200, 2, ["K", "M"]), (2, 0, "kurz", None, [])]
    got = chunking.chunk_documents(spark.createDataFrame(rows, "doc_id long, ordinal int, text string, page int, header_path array<string>")).orderBy("doc_id", "ordinal").collect()
    assert [r.page for r in got if r.doc_id == 1] == [1, 2] and got[0].text.startswith("K › M\n\neins") and got[-1].text == "kurz"


def test_upsert_and_need(spark):
    cols = "doc_id string, content_hash string, placement_hash string, sync_id string, tombstoned_at int, extract_version int, skip_reason string, last_seen int"
    old = spark.createDataFrame([("a", "1", "p", "s", None, 3, None, 1), ("b", "1", "p", "s", 5, 3, None, 1), ("c", "1", "p", "s", None, 3, "x", 1)], cols)
    new = spark.createDataFrame([("a", "1", None), ("b", "1", "q"), ("d", "1", "p")], "doc_id string, content_hash string, placement_hash string")
    got = {r.doc_id: r for r in sync.upsert(old, new, ["doc_id"], 9).collect()}
    assert got["a"].extract_version == 3 and got["a"].placement_hash == "p" and got["b"].tombstoned_at is None and got["b"].extract_version is None and got["c"].last_seen == 1 and got["d"].last_seen == 9
    assert sorted(ids(sync.need(old, new, ["doc_id"]))) == ["b", "d"]


def test_sync_runs(spark):
    docs = spark.createDataFrame([("1:2:a", 1, None, None), ("1:2:b", 5, None, None), ("1:3:a", 1, "run", None)], "doc_id string, seen_seq int, sync_id string, tombstoned_at int")
    assert [r.doc_id for r in sync.finish(docs, "run", 3, 9).where("tombstoned_at = 9").collect()] == ["1:2:a"]
    assert sync.finish(docs, "run", 3, 9, mode="incremental").where("tombstoned_at = 9").count() == 0
    assert sync.finish(docs, "run", 3, 9, state="finished").where("tombstoned_at = 9").count() == 0
    with pytest.raises(RuntimeError):
        sync.finish(docs, "run", 3, 100_000, last_activity=0)
    gone = sync.tombstone(docs, spark.createDataFrame([("1:2:*",), ("1:3:a",)], "doc_id string"), 7)
    assert gone.where("tombstoned_at = 7").count() == 3


def test_job_outcomes(spark):
    df = spark.createDataFrame([(None,), ("transient",), ("missing-blob",), ("broken",)], "error string")
    assert [r.outcome for r in jobs.outcome(df).collect()] == ["done", "retry", "waiting", "skipped"]


def test_log_merge_and_replay(spark):
    rows = [("c", 1, "user", "t", "hi"), ("c", 2, "token", "t", "Ha"), ("c", 3, "token", "t", "llo"), ("c", 4, "final", "t", None)]
    log = spark.createDataFrame(rows, "conversation_id string, seq long, type string, turn_id string, delta string")
    merged = events.merge_runs(log)
    assert [(r.seq, r.delta, r.parts) for r in merged.orderBy("seq").collect()] == [(1, "hi", None), (3, "Hallo", [2, 3]), (4, None, None)]
    assert [(r.seq, r.delta) for r in events.replay(merged, 2).orderBy("seq").collect()] == [(3, "llo"), (4, None)]
    assert events.pending_question(log.withColumn("type", F.when(F.col("seq") == 4, "question").otherwise(F.col("type")))).first().seq == 4


def test_burst_ignores_refused(spark):
    rows = [(1, t, i) for i, t in enumerate([0, 10, 20, 61, 62, 75])]
    df = spark.createDataFrame(rows, "user_id long, ts long, event_id long")
    got = [r.allowed for r in events.burst(df, 2).orderBy("event_id").collect()]
    assert got == [True, True, False, True, False, True]


def test_names_and_paths(spark):
    assert tree.settle_names(["a", "a", "a (2)", "a"]) == ["a", "a (2)", "a (2) (2)", "a (3)"]
    names = spark.createDataFrame([("x", i, n) for i, n in enumerate(["a", "a", "a (2)", "a"])] + [("y", 9, "a"), ("y", 8, "a")], "p string, i int, n string")
    got = {(r.p, r.i): r.o for r in tree.unique_names(names, ["p"], "n", ["i"], "o").collect()}
    assert got == {("x", 0): "a", ("x", 1): "a (2)", ("x", 2): "a (2) (2)", ("x", 3): "a (3)", ("y", 8): "a", ("y", 9): "a (2)"}
    assert tree.unique_names(names.where("p = 'y'"), [], "n", ["i"], "o").count() == 2
    paths = spark.createDataFrame([("/Netze/Woche 1/a",), ("/Netze/Einführung/b",), ("/Node/c",)], "path string")
    assert tree.resolve(paths, "netze/wo") == "/Netze/Woche 1" and tree.resolve(paths, "/Netz/Einfuhrung") == "/Netze/Einführung"
    with pytest.raises(LookupError):
        tree.resolve(paths, "/N")


def test_tree_fallbacks(spark):
    rows = [(1, "d1", 5, 1, None, 10, "a/b", "t"), (1, "d2", 5, 1, "", 11, "", ""), (1, "d3", 6, 2, "S", 12, "M", "x"), (1, "d4", 6, 2, "S", 12, "M", "x")]
    docs = spark.createDataFrame(rows, "course_id int, doc_id string, section_id int, section_order int, section_name string, cmid int, module_name string, title string")
    got = {r.doc_id: r.path for r in tree.tree_paths(docs, spark.createDataFrame([(1, "")], "course_id int, fullname string")).collect()}
    assert got == {"d1": "/Kurs 1/Abschnitt 1/a-b", "d2": "/Kurs 1/Abschnitt 1/Inhalt", "d3": "/Kurs 1/S/M/x", "d4": "/Kurs 1/S/M/x (2)"}


def test_tools(spark, world):
    paths = spark.createDataFrame([(1, "/K/S/a"), (2, "/K/S/b"), (3, "/K/T/c"), (4, "/K/T/d")], "doc_id long, path string")
    c = tools.Corpus(world, paths, allowed=world.where("cmid <> 13").select("cmid"))
    r = tools.standard()
    assert {x.doc_id for x in r.call("search_text", c, query="netze").collect()} == {1, 2}
    assert {x.doc_id for x in r.call("search_content", c, query="netze", path="/k/s").collect()} == {1, 2}
    assert [(x.name, x.n) for x in r.call("list_dir", c, path="/K").collect()] == [("S", 2), ("T", 1)]
    assert r.call("read_file", c, path="/K/S/b", limit=4).first().text == "Netz"
    assert ids(r.call("list_documents", c, limit=2)) == [3, 2]
    with pytest.raises(ValueError):
        r.call("search_text", c, query="x", k=99)
    with pytest.raises(LookupError):
        r.call("read_file", c, path="/nowhere")
    with pytest.raises(ValueError):
        r.register("list_dir", tools.list_dir)


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def test_formats(spark):
    assert formats.extract(b"<html><body><nav>x</nav><p>Hallo</p><img alt='Bild'><img></body>", "a")[0][0] == "Hallo\n[Bild: Bild]\n[Bild]"
    assert formats.extract("Grüße".encode("cp1252"), "a.txt") == [("Grüße", None, None)]
    assert formats.extract(b"[InternetShortcut]\nURL= https://x ", "a.url")[0][0] == "https://x"
    w = 'xmlns:w="w"'
    docx = archive({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Eins</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    assert formats.extract(docx, "renamed.bin") == [("Eins\na | b", None, None)]
    pptx = archive({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": "<s><p><t>Titel</t></p></s>", "ppt/notesSlides/notesSlide1.xml": "<n><p><t>Merke</t></p></n>"})
    assert formats.extract(pptx, "a.pptx") == [("Titel\nNotizen: Merke", 1, "Folie 1")]
    xlsx = archive({"xl/workbook.xml": '<w><sheet name="Plan"/></w>', "xl/sharedStrings.xml": "<s><si><t>Tag</t></si></s>", "xl/worksheets/sheet1.xml": '<s><row><c t="s"><v>0</v></c><c><v>3</v></c></row><row><c/></row></s>'})
    assert formats.extract(xlsx, "a.xlsx") == [("Tag | 3", 1, "Plan")]
    odt = archive({"content.xml": "<o><h>Kopf</h><p>Text <b>fett</b></p></o>"})
    assert formats.extract(odt, "a.odt") == [("Kopf\n\nText fett", None, None)]
    with pytest.raises(formats.Unsupported):
        formats.extract(b"%PDF-1.7", "a.txt")
    files = spark.createDataFrame([(1, "a.txt", bytearray(b"hi")), (2, "b.rtf", bytearray(b"{"))], "doc_id long, name string, content binary")
    got = {r.doc_id: (r.text, r.error is None) for r in formats.extract_files(files).collect()}
    assert got == {1: ("hi", True), 2: (None, False)}
    kinds = files.select(formats.sniff(F.col("content"), F.col("name")).alias("k")).collect()
    assert [r.k for r in kinds] == ["text", None]


def test_boards(spark):
    boards = spark.createDataFrame([(1, "Tafel")], "board_id int, name string")
    lists = spark.createDataFrame([(1, "l1", 0, "Thema")], "board_id int, list_id string, pos int, name string")
    cards = spark.createDataFrame([(1, "l1", 0, "<b>A</b>", "<p>x</p>"), (1, None, 1, "B", None)], "board_id int, list_id string, pos int, title string, description string")
    assert connectors.render_board(boards, lists, cards).first().text == "Tafel\n\nThema:\n- A: x\n- B"


def test_embedding_cache(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma")], "id int, text string")
    cache = spark.createDataFrame([], "lookup string, key string, vector array<float>")
    rows, grown = embedding.embed_cached(texts, cache, embedding.hash_embedder(8), "k")
    assert grown.count() == 2 and all(abs(sum(x * x for x in r.vector) - 1) < 1e-5 for r in rows.collect())
    bad, _ = embedding.embed_cached(texts, cache, failing, "k")
    assert all(r.vector is None for r in bad.collect())


def test_occurrences_overlap_and_prefixes(spark):
    texts = ["the the the", "Of the, of THE of", "", None, "ofthe of  the\nof then", "Straße über über", "...of the..."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    line = search.token_line("t")
    n = lambda *a: [r[0] for r in df.orderBy("i").select(search.occurrences(line, *a)).collect()]
    assert n(["the", "the"], False) == [2, 0, 0, 0, 0, 0, 0] and n(["of", "the"], False) == [0, 2, 0, 0, 1, 0, 1]
    assert n(["of", "the"], True) == [0, 2, 0, 0, 2, 0, 1] and n(["uber"], False) == [0, 0, 0, 0, 0, 2, 0]
    lengths = [r[0] for r in df.orderBy("i").select(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) - 1).collect()]
    assert lengths == [r[0] for r in df.orderBy("i").select(F.size(search.T.index_tokens("t"))).collect()]


def test_phrase_plan_splits_no_text_twice(spark, world):
    plan = search.bm25(world, "of the", "phrase")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
    body = plan[: plan.index("scalar-subquery") if "scalar-subquery" in plan else None]
    assert body.count("regexp_replace(") <= 2


def test_index_gives_what_the_scan_gives(spark, world, tmp_path):
    search.write_index(world, f"file://{tmp_path}/index")
    for query, mode in (("netze domanen", "any"), ("netze netz", "all"), ("netz aus netzen", "phrase"), ("802.1Q", "any"), ("ne", "any"), ("nosuchword", "any"), ("", "any")):
        want = {(r.doc_id, r.score) for r in search.bm25(world, query, mode).collect()}
        assert {(r.doc_id, r.score) for r in search.indexed_bm25(spark, f"file://{tmp_path}/index", query, mode).collect()} == want
    scoped = search.indexed_bm25(spark, f"file://{tmp_path}/index", "netze", scope=world.where("doc_id = 1"))
    assert ids(scoped) == [1]
    plan = search.indexed_bm25(spark, f"file://{tmp_path}/index", "netz aus", "phrase")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term" in plan


def test_matches_keep_their_places(spark):
    rows = [(1, "aXbXXc" * 3), (2, "no"), (3, "Xx " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    import re

    got = [(r.doc_id, r.n, r.start, r.match) for r in search.regex_matches(df, "X+", most=None).orderBy("doc_id", "n").collect()]
    assert got == [(d, n, m.start(), m.group()) for d, t in rows for n, m in enumerate(re.finditer("X+", t))]
    assert [(r.doc_id, r.n, r.around) for r in search.regex_matches(df, "X+", context=1, most=4).collect()] == [(1, 0, "aXb"), (1, 1, "bXXc"), (1, 2, "aXb"), (1, 3, "bXXc")]


def test_updates_of_the_store(spark, tmp_path):
    sites_ = spark.createDataFrame([("a", 1, None)], "site_id string, created_at int, last_seen int")
    assert store.touch_sites(sites_, spark.createDataFrame([("a", 5), ("a", 3)], "site_id string, ts int")).first().last_seen == 5
    assert store.add_sites(sites_, spark.createDataFrame([("b", 2, None)], sites_.schema)).count() == 2
    with pytest.raises(Exception, match="registered"):
        store.add_sites(sites_, sites_).collect()
    runs = spark.createDataFrame([("a", "full", "open", 100_000)], "site_id string, mode string, state string, last_activity int")
    assert store.open_full_sync(runs, "a", 150_000) and not store.open_full_sync(runs, "a", 190_000) and not store.open_full_sync(runs, "b", 150_000)
    path = f"file://{tmp_path}/usage"
    for _ in range(2):
        store.append(runs, path)
    assert spark.read.parquet(path).count() == 2
    images = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"y"))], "doc_id int, content binary")
    known, lost = store.ocr_split(images, spark.createDataFrame([("2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881:m", "text")], "key string, text string"), "m")
    assert [r.doc_id for r in known.collect()] == [1] and [r.doc_id for r in lost.collect()] == [2]
    assert sorted(r[0] for r in spark.createDataFrame([("student",), ("x",)], "r string").select(store.labelled(F.col("r"), store.ROLES)).collect()) == ["Teilnehmer/in", "x"]
    assert outbox.counts(spark.createDataFrame([(0,), (3,), (12,)], "attempts int")).first() == (2, 1, 1)


def test_requests(spark, tmp_path):
    doc = '{"doc_id": "1:2:a", "kind": "inline", "text": "x"}'
    for name, body in (("a", f"[{doc}, {doc}]"), ("b", '{"documents": [' + doc + "]}"), ("c", f"{doc}\n{doc}\n")):
        (tmp_path / f"{name}.json").write_text(body)
    assert [connectors.unwrapped(spark, f"file://{tmp_path}/{n}.json").where("doc_id = '1:2:a'").count() for n in "abc"] == [2, 1, 2]
    rows = spark.range(501)
    assert connectors.bounded_request(rows.limit(500)).count() == 500
    with pytest.raises(ValueError):
        connectors.bounded_request(rows)
    mods = spark.createDataFrame([(1, 2, "folder", "F", "", None, None, None)], "course_id int, cmid int, modname string, name string, intro string, content string, url string, chapters array<string>")
    files = spark.createDataFrame([(2, "/a/", "h", "b.pdf")], "cmid int, path string, sha256 string, filename string")
    assert [(r.doc_id, r.content_hash, r.kind) for r in connectors.modules_to_documents(mods, files).collect()] == [("1:2:file:/a/b.pdf", "h", "file")]


def test_unique_names_without_parents_settle_by_base(spark):
    """The same as settling all siblings together, though only names alike but for numbers meet."""
    names = ["x", "x (2)", "x", "x", "y", "y", "x (2)", "z (2)", "x (2) (2)", "z", "z", "y (3)", "(2)", "w (2) (3)", "w", "w (2)", "w (2)"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    got = [r["u"] for r in sorted(tree.unique_names(df, [], "n", ["i"], "u").collect(), key=lambda r: r["i"])]
    assert got == tree.settle_names(names)
    both = df.withColumn("p", F.col("i") % 2)
    got = {r["i"]: r["u"] for r in tree.unique_names(both, ["p"], "n", ["i"], "u").collect()}
    assert [got[i] for i in range(0, 17, 2)] == tree.settle_names(names[::2]) and [got[i] for i in range(1, 17, 2)] == tree.settle_names(names[1::2])
