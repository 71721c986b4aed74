"""Text, URL and time functions on hand-made rows."""

from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lectern.functions import moments as M
from lectern.functions import text as T
from lectern.functions import urls as U
from lectern.functions import vectors as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [("a\r\nb\rc", "a\nb\nc"), ("a \t b  \n\n\n\n c ", "a b\n\nc"), ("", ""), ("\n\n", "")])
def test_normalise(spark, raw, want):
    assert one(spark, raw, T.normalise_text) == want


@pytest.mark.parametrize(("raw", "want"), [("<p>Hallo <b>Welt</b></p><script>x('</p>')</script>", "Hallo Welt"), ("a<br>b&amp;c &lt;d&gt;", "a\nb&c <d>"), (None, ""), ("<li>1</li><li>2</li>", "1\n2")])
def test_html_to_text(spark, raw, want):
    assert one(spark, raw, T.html_to_text) == want


def test_titles(spark):
    assert one(spark, "  a\n b ", T.clean_title) == "a b"
    long = one(spark, "x" * 100, T.clean_title)
    assert len(long) == 80 and long.endswith("…")
    assert one(spark, None, lambda c: T.clean_title(c, "none")) == "none"
    assert one(spark, '\n## Titel: "Netze und Protokolle."\nmore', T.chat_title) == "Netze und Protokolle"
    assert one(spark, " \n ", T.chat_title) is None
    assert one(spark, "wort " * 20, T.chat_title).endswith("wort…")


def test_folding_and_tokens(spark):
    assert one(spark, "Domänen Straße ñandú", T.fold) == "domanen straße nandu"
    assert one(spark, "802.1Q, 'Été'!", T.index_tokens) == ["802", "1q", "ete"]


def test_sentences_and_breadcrumb(spark):
    assert one(spark, "Eins. Zwei!\nDrei: vier\n\n \n\nFünf", T.sentences) == ["Eins.", "Zwei!", "Drei:", "vier", "Fünf"]
    assert one(spark, ["a", "", None, "b"], T.breadcrumb, "array<string>") == "a › b"
    assert one(spark, "2:10:a:b", T.doc_id_parts) == (2, 10, "a:b")


@pytest.mark.parametrize(
    ("url", "f", "want"),
    [
        ("https://www.youtube.com/watch?v=abc&t=1", U.youtube_id, "abc"),
        ("https://youtu.be/abc", U.youtube_id, "abc"),
        ("https://youtube.com/feed", U.youtube_id, None),
        ("https://hackmd.io/xyz?view#a", U.hackmd_export, "https://hackmd.io/xyz.md"),
        ("https://hackmd.io/", U.hackmd_export, None),
        ("https://cloud.org/index.php/s/abcd12?dir=/", U.share_download, "https://cloud.org/index.php/s/abcd12/download"),
        ("https://cloud.org/apps/files", U.share_download, None),
        ("https://x.taskcards.app/#/board/01234567-89ab-cdef-0123-456789abcdef?token=t1", U.board_id, "01234567-89ab-cdef-0123-456789abcdef"),
        ("https://x.taskcards.app/#/board/01234567-89ab-cdef-0123-456789abcdef?token=t1", U.share_token, "t1"),
        ("HTTPS://User@Example.ORG:443/a", U.origin, "https://example.org"),
        ("http://[::1]:8080/", U.origin, "http://[::1]:8080"),
        ("null", U.origin, None),
        ("ftp://a/b", U.source_kind, "error"),
        ("https://example.org", U.source_kind, None),
    ],
)
def test_urls(spark, url, f, want):
    assert one(spark, url, f) == want


def test_google_export(spark):
    assert tuple(one(spark, "https://docs.google.com/presentation/d/i1/edit", U.google_export)) == ("https://docs.google.com/presentation/d/i1/export/pptx", "pptx")
    assert one(spark, "https://docs.google.com/document/d//edit", U.google_export) is None


def test_moments(spark):
    now = datetime(2026, 11, 10, 9, 30, tzinfo=ZoneInfo("Europe/Berlin"))
    day = int(datetime(2026, 11, 10, tzinfo=now.tzinfo).timestamp())
    at = int(now.timestamp())
    words = {
        "heute": (day, day + 86399), "Tomorrow": (day + 86400, day + 2 * 86400 - 1), "-7d": (day - 7 * 86400, day - 6 * 86400 - 1), "+ 2 w": (day + 14 * 86400, day + 15 * 86400 - 1),
        "-2h": (at - 7200, at - 7200), "2026-11-10": (day, day + 86399), "20261110": (day, day + 86399), "2026-11-10T10:00": (day + 36000,) * 2, "2026-11-10T10:00:05Z": (day + 36005 + 3600,) * 2,
        "-1m": (int(datetime(2026, 10, 11, tzinfo=now.tzinfo).timestamp()), int(datetime(2026, 10, 12, tzinfo=now.tzinfo).timestamp()) - 1), " ": (None, None), None: (None, None),
    }
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: (r.lo, r.hi) for r in df.select("w", M.moment(F.col("w"), F.lit(at), "Europe/Berlin").alias("lo"), M.moment(F.col("w"), F.lit(at), "Europe/Berlin", True).alias("hi")).collect()}
    assert got == words
    with pytest.raises(Exception, match="not a date"):
        spark.createDataFrame([("soon",)], "w string").select(M.moment(F.col("w"), F.lit(at))).collect()


def test_entities(spark):
    import html

    texts = ["a &amp; b", "&auml;&ouml;&hearts;&nosuch; &#233;&#xE9;&#x1F600;", "&amp;lt;", "no", "", "&", "a&b;c&", "&lt;p&gt;&quot;&nbsp;x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.u for r in df.select("t", T.unescape("t").alias("u")).collect()} == {t: html.unescape(t) for t in texts}


def test_windows_follow_clock_changes(spark):
    berlin = ZoneInfo("Europe/Berlin")
    noon = int(datetime(2026, 10, 25, 12, tzinfo=berlin).timestamp())
    row = spark.createDataFrame([(noon,)], "t long").select(M.window_start(F.col("t"), "day", "Europe/Berlin").alias("a"), M.window_end(F.col("t"), "day", "Europe/Berlin").alias("b"), M.window_end(F.col("t"), "month", "Europe/Berlin").alias("m")).first()
    assert row.b - row.a == 25 * 3600
    assert row.m == int(datetime(2026, 11, 1, tzinfo=berlin).timestamp())


def test_waiting(spark):
    row = spark.range(1).select(M.backoff(F.lit(3), 10).alias("a"), M.backoff(F.lit(20), 10).alias("b"), M.backoff(F.lit(0), 1, 99.0).alias("c"), M.outbox_backoff(F.lit(1)).alias("d"), M.retry_after(F.lit("120"), F.lit(0)).alias("e"), M.retry_after(F.lit("Thu, 01 Jan 1970 00:01:00 GMT"), F.lit(0)).alias("f")).first()
    assert tuple(row) == (80.0, 3600.0, 99.0, 60, 120.0, 60.0)


def test_vectors(spark):
    assert one(spark, [0.0, 0.0], V.l2_normalise, "array<double>") == [0.0, 0.0]
    row = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(V.cosine_distance("a", "b").alias("far"), V.cosine_distance("a", "z").alias("zero")).first()
    assert tuple(row) == (2.0, 0.0)


def test_payloads(spark):
    from lectern.functions import payloads as P

    assert P.summary("{query} in {path}", {"query": "x"}, "Suche") == "x in " and P.summary("{0}", {}, "Suche") == "Suche"
    rows = spark.createDataFrame([(None,), ("{}",), ('{"reasoning": "x"}',), ("rubbish",)], "p string")
    assert [r[0] for r in rows.select(P.reasoning_text(F.col("p"))).collect()] == ["", "", "x", ""]
    assert [r[0] for r in rows.select(P.usage_of(F.col("p"))["input_tokens"]).collect()] == [None, None, 0, 0]
    assert one(spark, "a", lambda c: P.encoded(F.col(c) if isinstance(c, str) else c)) is not None
