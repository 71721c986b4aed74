"""Main text of web pages: what markup names, and for the rest what repeats on a host.

Each page is cut into blocks of text. Markup that says what it is decides first: articles and main
parts are text; menus, footers, asides, forms, adverts, notices and comments are not. For what is left
open, the pages of a host are one long stream of tokens, and a suffix array of that stream tells which
runs recur on other pages: suffixes that agree in their first DEPTH tokens stand together in it. Only
that depth matters, since a longer run is a union of such windows; so suffixes are named by these
tokens (64 bits) and grouped, in pieces over all executors also for one host. Blocks that runs cover
are boilerplate, and the page keeps its unique ones.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.urls import host
from lectern.llm.common import pick, ship, stored

#: Tokens that suffixes must share to be a run, distinct pages that hold it, and their share of the host's.
DEPTH, PAGES, SHARE = 6, 3, 0.05

#: A tag, with quoted values that may hold ``>``; or a comment, declaration or instruction.
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>|!--.*?(?:-->|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; none of it is text of the page.
RAW = frozenset("script style title textarea noscript template iframe svg math object canvas audio video select".split())
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset(("td", "th"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What an opening tag ends, up to the nearest of the second.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

#: Not text by the element's name, or by words of its class, id or role. The first kind holds whatever is inside; an article inside the second kind is text.
HARD = frozenset("nav aside footer menu dialog".split())
SOFT = frozenset(("form", "button"))
HARD_WORDS = frozenset("comment comments respond disqus replies sidebar aside footer nav navbar navigation menu breadcrumb breadcrumbs related recommended complementary contentinfo".split())
SOFT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social pagination pager toolbar widget masthead search form".split())
LAYOUT_WORDS = frozenset("with without has have no layout wrapper container page main content body".split())
REFUSED_WORDS = HARD_WORDS | SOFT_WORDS
HEADER_WORDS = frozenset(("header", "masthead"))
#: The text by what an element says of itself, best first.
BEST, GOOD, FAIR = 3, 2, 1
FAIR_WORDS = frozenset("content article post entry story".split())


@lru_cache(4096)
def _said(attributes: str) -> tuple[frozenset, bool, bool]:
    """The words of class, id and role; whether role is main; whether it is named an article's body."""
    words, main, body = set(), False, False
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        name = m[1].lower()
        main |= name == "role" and value.strip().lower() == "main"
        body |= name == "itemprop" and value.strip().lower() == "articlebody"
        if name != "itemprop":
            for name in value.split():
                own = {w.lower() for w in _WORD.findall(name)}
                # A layout that has a sidebar is none.
                words |= own - REFUSED_WORDS if own & LAYOUT_WORDS else own
    return frozenset(words), main, body


def _region(name: str, attributes: str, now: tuple[int, int, bool]) -> tuple[int, int, bool]:
    """(mark, refusal, only headings) within an element, from those around it; refusal 2 is for good."""
    mark, refused, heading = now
    words, main, body = _said(attributes) if "=" in attributes else (frozenset(), False, False)
    if name in ("article", "main") or main or body:
        own = GOOD if (name == "main" or main) and name != "article" and not body else BEST
        if words & HARD_WORDS and name == "article":
            return mark, 2, heading
        return max(mark, own), 2 if refused == 2 else 0, False
    if name in ("html", "body"):
        return now
    if name in HARD or words & HARD_WORDS:
        return mark, 2, heading
    if name in SOFT or words & SOFT_WORDS:
        return mark, max(refused, 1), heading
    if name == "header" or words & HEADER_WORDS:
        return (mark, refused, True) if mark >= GOOD else (mark, max(refused, 1), heading)
    if words & FAIR_WORDS:
        mark = max(mark, FAIR)
    return mark, refused, heading


def blocks(html: str) -> list[tuple[str, int, bool]]:
    """The page's blocks of text, in order: text, mark, whether markup refuses it."""
    out: list[tuple[str, int, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, tuple[int, int, bool]]] = []
    now, at = (0, 0, False), 0

    def put(end: int) -> None:
        if end > at:
            piece = html[at:end]
            if not (now[2] and not any(s[0] in HEADINGS for s in stack)):
                held.append(unescape(piece) if "&" in piece else piece)

    def close() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((text, now[0], now[1] > 0))

    def cut(k: int) -> None:
        nonlocal now
        del stack[k:]
        now = stack[-1][1] if stack else (0, 0, False)

    size, m = len(html), _TAG.search(html)
    while m:
        put(m.start())
        at = m.end()
        if m[2]:
            name = m[2].lower()
            block = name in BLOCKS
            if block:
                close()
            elif name in CELLS:
                held.append(" ")
            if m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        outer = stack[k - 1][1] if k else (0, 0, False)
                        if stack[k][1] != outer:
                            close()
                        if block or name in CELLS or k == len(stack) - 1 or stack[k][1] != outer:
                            cut(k)
                        else:
                            del stack[k]  # misnested: what was opened within goes on
                        break
                    if stack[k][0] in BLOCKS and not block and name not in CELLS:
                        break  # a stray end of something inline
                    if stack[k][0] in ("article", "main", "body") and name in ("p", "li", "dd", "dt", "tr"):
                        break
            elif name in RAW:
                # Its end is looked for by name; without one the rest of the page belongs to it.
                if not m[3].endswith("/"):
                    end = _end_of(name).search(html, at)
                    at = end.end() if end else size
            elif name not in VOID:
                if name in ENDS:
                    own, stop = ENDS[name]
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in stop:
                            break
                        if stack[k][0] in own.split():
                            close()
                            cut(k)
                            break
                elif block:
                    # A paragraph ends where another block begins, with all inline elements in it.
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == "p":
                            cut(k)
                            break
                        if stack[k][0] in BLOCKS or stack[k][0] in CELLS:
                            break
                inner = _region(name, m[3], now)
                if inner != now:
                    close()
                stack.append((name, inner))
                now = inner
        m = _TAG.search(html, at)
    put(size)
    close()
    return out


@lru_cache(64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


@lru_cache(1 << 16)
def _named(token: str) -> int:
    return xxhash.xxh64_intdigest(token)


def windows(tokens: list[str], seed: int, depth: int) -> np.ndarray:
    """A name for the first ``depth`` tokens of each suffix that has as many."""
    n = len(tokens) - depth + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    names = np.fromiter(map(_named, tokens), np.uint64, len(tokens))
    out = np.full(n, seed, np.uint64)
    for j in range(depth):
        out = (out ^ names[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


_PARSED = "row long, page_id {id}, url string, host string, page long, text string, blocks array<string>, ends array<int>, keys array<long>"


def _parsed(schema: pa.Schema, depth: int, marks: bool):
    def run(batches):
        for b in batches:
            rows = []
            for html, site in zip(b.column("html"), b.column("host"), strict=True):
                html, site = html.as_py() or "", site.as_py() or ""
                found = blocks(html) if marks else [(t, 0, False) for t, *_ in blocks(html)]
                best = max((mark for _, mark, refused in found if not refused), default=0)
                text = "\n".join(t for t, mark, refused in found if mark == best and not refused) if best else None
                # The stream is what no mark claims; of pages with marks it only tells what recurs.
                outside = [(t, refused) for t, mark, refused in found if refused or mark < best or not best]
                tokens, ends, left = [], [], []
                for t, refused in outside:
                    tokens += t.split(" ")
                    if not best and not refused:
                        left.append(t)
                        ends += [len(tokens) - t.count(" ") - 1, len(tokens)]
                rows.append((xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass")) - (1 << 63), text, left, ends, windows(tokens, xxhash.xxh64_intdigest(site), depth)))
            made = [pa.array([r[k] for r in rows], schema.field(n).type) for k, n in enumerate(("page", "text", "blocks", "ends", "keys"))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("page_id"), b.column("url"), b.column("host"), *made], schema=schema)

    return run


def _unique(batches):
    """Of pages without marks the blocks of which no half is covered."""
    for b in batches:
        texts = []
        for parts, ends, places, depth in zip(b.column("blocks").to_pylist(), b.column("ends").to_pylist(), b.column("places").to_pylist(), b.column("depth").to_pylist(), strict=True):
            covered = np.zeros((ends[-1] if ends else 0) + depth + 1, np.int64)
            for p in places or ():
                if p < len(covered):
                    covered[p] += 1
                    covered[min(p + depth, len(covered) - 1)] -= 1
            sums = np.concatenate(([0], np.cumsum(np.cumsum(covered) > 0)))
            kept = [t for t, a, z in zip(parts, ends[::2], ends[1::2], strict=True) if 2 * (sums[z] - sums[a]) < z - a]
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, depth: int = DEPTH, least: int = PAGES, share: float = SHARE, marks: bool = True) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Where a page marks its article (or else its main part, or else a block by its class), that is the
    text, without what markup refuses in it, and whatever of it other pages have too. Other pages keep
    the blocks that markup does not refuse and that are not covered, to half of their tokens, by runs of
    ``depth`` or more tokens that ``least`` distinct pages of the host hold, and a ``share`` of them all. Pages of
    equal html count as one, so copies of a page do not make it boilerplate. Without ``marks`` all pages
    are treated so, and repetition alone decides.

    References are decoded; white space within a block is one space; blocks are lines. A null html is
    empty, as is the text of a page that has none. Pages with null urls are those of one host. Rows
    with one page_id stay apart. An empty table gives no rows; columns whose names are like others do
    not matter. A page is parsed in memory, whatever its length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(pages.sparkSession)
    base = pick(pages, "page_id", "url", "html").withColumn("row", F.monotonically_increasing_id()).withColumn("host", F.coalesce(host(F.col("url")), F.lit("")))
    told = _PARSED.format(id=base.schema["page_id"].dataType.simpleString())
    schema = to_arrow_schema(_parse_datatype_string(told))
    parsed = stored(base.select("row", "page_id", "url", "host", "html").mapInArrow(_parsed(schema, depth, marks), told), "pages", compression="zstd")
    marked = parsed.where("text IS NOT NULL").select("page_id", "url", "text")
    open_pages = parsed.where("text IS NULL")
    if open_pages.isEmpty():
        texts = marked
    else:
        # Names hold their host. Counted are distinct pages; both counts combine before the shuffle.
        sizes = parsed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
        held = parsed.select("host", "page", F.explode("keys").alias("key")).distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        runs = held.join(sizes, "host").where(F.col("n") >= share * F.col("pages")).select("key")
        places = open_pages.select("row", F.posexplode("keys").alias("place", "key")).join(runs, "key").groupBy("row").agg(F.collect_list("place").alias("places"))
        rest = open_pages.join(places, "row", "left").select("page_id", "url", "blocks", "ends", "places", F.lit(depth).alias("depth"))
        texts = marked.unionAll(rest.mapInArrow(_unique, f"page_id {base.schema['page_id'].dataType.simpleString()}, url string, text string"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
