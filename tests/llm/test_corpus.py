"""Merkle manifests, importance resampling and main texts of pages."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from lectern.llm import html_main, merkle, queries
from lectern.llm.common import fold, ranked
from tests.llm.conftest import ROWS, SCHEMA


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded, verified of rows (doc_id, text, lang, source, n_chars), level by level."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, la, s, n: h(*map(field, (d, s, la, n, t)))

    def tree(nodes):
        """Levels from the lowest."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
        return levels

    def path(levels, i):
        """For each level below the root: the siblings before, and after."""
        out = []
        for level in levels[:-1]:
            a = i - i % 2
            out.append((level[a:i], level[i + 1 : a + 2]))
            i //= 2
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {la: sorted((r for r in rows if r[2] == la), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for la in langs}
    trees = {la: tree([leaf(*r) for r in own[la]]) for la in langs}
    top = tree([trees[la][-1][0] for la in langs])
    out = []
    for k, la in enumerate(langs):
        for i, r in enumerate(own[la]):
            steps = path(trees[la], i) + path(top, k)
            now = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                now = leaf(*r[:4], r[4] + 1)
            for a, b in steps:
                now = h(*a, now, *b)
            out.append((r[0], leaf(*r), trees[la][-1][0], top[-1][0], h(*(x for a, b in steps for x in a + b)), now, now == top[-1][0]))
    return out


def manifest_of(docs):
    from pyspark.sql import functions as F

    return merkle.manifest(docs, F.col("doc_id").isNotNull() & (fold("doc_id", 7) == 0), {"n_chars": F.col("n_chars") + 1})


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], [(i, f"t{i}", "xy"[i % 3 == 0], None, i) for i in range(601)], [(i, "a", f"l{i}", "s", 1) for i in range(300)]], ids=["edge", "one", "blocks", "groups"])
def test_manifest(spark, rows):
    got = [tuple(r) for r in manifest_of(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_clashing_names_and_of_nothing(spark, edge, empty):
    got = [tuple(r) for r in manifest_of(edge).collect()]
    assert sorted(got, key=key) == sorted(plain_manifest(ROWS), key=key)
    assert manifest_of(empty).collect() == []


def test_preimage_slots():
    a, b, c = "a" * 64, "b" * 64, "c" * 64
    assert merkle.without(a + b, 0) == b and merkle.without(a + b, 1) == a and merkle.without(a, 0) == ""
    assert merkle.spliced(a + b, 0, c) == c + b and merkle.spliced(a + b, 1, c) == a + c


def test_ranked(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).repartition(7).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    rows = ranked(df, "place", F.desc("k"), F.asc("id")).collect()
    assert [(r["k"], r["id"]) for r in sorted(rows, key=lambda r: r["place"])] == sorted(((r["k"], r["id"]) for r in rows), key=lambda x: (-x[0], x[1]))
    assert sorted(r["place"] for r in rows) == list(range(1000))


def plain_resampling(docs, target, percent, least, most=1, buckets=10_000, seed=2024):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(words(x))) for texts in ([d[1] for d in docs], target))
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    out = []
    for i, text, *_ in docs:
        w = words(text)
        weight = sum(gain(bucket(f)) for f in runs(w))
        x = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(runs(w)), weight, weight + math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("most", [1, 3])
def test_resampling(spark, edge, tiny, most):
    from lectern.llm.resampling import resampled

    target = spark.createDataFrame([("The lazy dog and the fox",), (None,), ("",), ("wort1 und2 café",)], "text string")
    tiny_rows = [tuple(r) for r in tiny.select("doc_id", "text").collect()]
    for docs, rows, percent, least in ((edge.where("doc_id IS NULL OR doc_id <> 7"), [r[:2] for r in ROWS if r[0] != 7], 60, 1), (tiny, tiny_rows, 10, 20)):
        got = [tuple(r) for r in resampled(docs, target, percent, least, most=most).collect()]
        assert sorted(got, key=key) == sorted(plain_resampling(rows, [r[0] for r in target.collect()], percent, least, most), key=key)


def test_resampling_of_nothing_and_of_repeats(spark, edge, empty):
    from lectern.llm.resampling import resampled

    target = spark.createDataFrame([], "text string")
    assert resampled(empty, target).collect() == []
    rows = resampled(edge, target, 100, 1).collect()
    assert len(rows) == len(ROWS) and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 1 + sum(r["n_features"] > 0 for r in rows)))


PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{margin:0}</style><script>var t="</p><article>x";</script></head>
<body class="no-sidebar"><header class="site-header"><h2>Site</h2></header><nav><ul><li><a href="/a">A</a><li>B</ul></nav>
<div class="cookie-notice">We use <b>cookies</b></div><!-- <p>hidden</p> -->
<div id="page-with-sidebar"><article><header><h1>Title  of
 it</h1><span>by X</span></header><p title="a > b">One &lt;two&gt;&nbsp;three<br>four<p>fi<b>ve</b> <i>six</i>
<div class="ad">Buy</div><aside>Aside</aside><form><input value="x">Send</form><ul><li>l1<li>l2</ul>
<table><tr><td>c1</td><td>c2</td></tr></table><section class="comments"><article class="comment"><p>Nice</p></article></section>
<noscript>off</noscript><p>&quot;end&quot; &am 1 < 2</article></div><div class="sidebar"><p>Links</p></div><footer>&copy; me</footer></body></html>"""


def test_blocks_of_a_marked_page():
    kept = [t for t, mark, refused in html_main.blocks(PAGE) if mark == 3 and not refused]
    assert kept == ["Title of it", "One <two> three", "four", "five six", "l1", "l2", "c1 c2", '"end" &am 1 < 2']


@pytest.mark.parametrize("html,texts", [
    ("", []),
    ("plain text", ["plain text"]),
    ("<p>a<p>b</b>c</div>d", ["a", "bc", "d"]),
    ("a<!-- open <p>b", ["a"]),
    ("<script>x", []),
    ("<p>a</p><p", ["a", "<p"]),
    ('<p class="x>y">q</p>', ["q"]),
    ("<div>a<span>b</span>c<div>d</div>e</div>", ["abc", "d", "e"]),
    ("<b><i>x</b>y</i><p>z", ["xy", "z"]),
])
def test_blocks(html, texts):
    assert [t for t, *_ in html_main.blocks(html)] == texts


def test_marks_by_name_role_and_class():
    for page, text in (("<main><p>a</p></main><p>b</p>", "a"), ('<div role="main">a</div>b', "a"), ('<div class="post-content">a</div><p>b', "a"), ('<div itemprop="articleBody">a</div><main>b</main>', "a"), ("<form><article>a</article></form>", "a"), ("<aside><article>x</article></aside><main>a</main>", "a")):
        found = html_main.blocks(page)
        best = max(m for _, m, r in found if not r)
        assert [t for t, m, r in found if m == best and not r] == [text], page


def test_repeated_runs_of_pages_without_marks(spark):
    """What recurs on a host goes; what one page has, or copies of it, stays; other hosts do not count."""
    chrome = "<div>Home News Sport Weather Travel and much more for you</div>{}<div>All rights reserved by the people of this place</div>"
    pages = [(i, f"http://a.example/{i}", chrome.format(f"<p>page {i} says {i} things of {i} its own</p><p>short {i}</p>")) for i in range(8)]
    pages += [(100 + i, "http://a.example/copy", chrome.format("<p>one text that three copies of a page have in common entirely</p>")) for i in range(4)]
    pages += [(200, "http://b.example/", chrome.format("<p>x</p>")), (201, None, None), (None, None, ""), (202, "http://a.example/m", chrome.format("<article>Home News Sport Weather Travel and much more for you</article>"))]
    got = {r["page_id"]: r for r in html_main.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages)
    for i in range(8):
        assert got[i]["text"] == f"page {i} says {i} things of {i} its own\nshort {i}"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"] == got[103]["text"] == "one text that three copies of a page have in common entirely"
    assert got[200]["text"].split("\n")[1] == "x" and got[200]["text"].startswith("Home News")
    assert got[202]["text"].startswith("Home") and got[201]["text"] == got[None]["text"] == ""


def test_windows_against_plain_suffixes():
    tokens = "a b c a b c a b d a b c".split()
    keys = html_main.windows(tokens, 7, 3)
    plain = [tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2)]
    assert len(keys) == len(plain) and all((keys[i] == keys[j]) == (plain[i] == plain[j]) for i in range(len(plain)) for j in range(len(plain)))
    assert not set(keys) & set(html_main.windows(tokens, 8, 3)) and len(html_main.windows(["a"], 7, 3)) == 0


def test_main_text_of_clashing_names_and_of_nothing(spark):
    from pyspark.sql import functions as F

    page = spark.createDataFrame([(1, "http://h.example", PAGE)], "page_id long, url string, html string").select(F.lit("x").alias("HTML"), "*", F.lit(1).alias("row"), F.lit("y").alias("host"))
    assert html_main.main_text(page).collect()[0]["text"].startswith("Title of it\n")
    assert html_main.main_text(page.limit(0)).collect() == []


def test_queries_cover_whole_tables(spark):
    got = queries.op13_main_text(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert not got.where("n_chars = 0").count()
