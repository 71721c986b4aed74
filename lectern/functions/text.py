"""Text functions on columns. All stay in the JVM; accents fold by a table made from Unicode's rules."""

from __future__ import annotations

import html.entities
import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TITLE_CHARS = 80
HEADER_SEPARATOR = " › "


def _fold_table() -> tuple[str, str]:
    """Small Latin letters with marks (U+00E0 to U+024F), and the plain letter of each."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xE0, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


FOLD_FROM, FOLD_TO = _fold_table()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case without accents; letters that have no plain form, such as sharp s, stay."""
    return F.translate(F.lower(col(c)), FOLD_FROM, FOLD_TO)


def index_tokens(c: Column | str) -> Column:
    """Folded runs of letters and numbers."""
    return F.filter(F.split(fold(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def normalise_text(c: Column | str) -> Column:
    """Line feeds only, single blanks, stripped lines, at most one blank line in a row, stripped."""
    c = F.regexp_replace(col(c), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\r\f\x0B]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)^[\p{Z}\s&&[^\n]]+|[\p{Z}\s&&[^\n]]+$", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


@cache
def _entities() -> dict[str, str]:
    """All named entities of HTML with their semicolon, by Python's table."""
    return {name[:-1]: char for name, char in html.entities.html5.items() if name.endswith(";")}


def unescape(c: Column | str) -> Column:
    """Entities of HTML, named and numeric ones, as characters, in one pass; others stay.

    Text is cut at ampersands, and the name that a part begins with looked up in a map.
    """
    names = F.lit(json.dumps(_entities()))
    table = F.from_json(names, "map<string, string>")
    parts = F.split(col(c), "&")

    def resolved(p: Column) -> Column:
        name = F.regexp_extract(p, "^(#?[0-9A-Za-z]{1,32});", 1)
        code = F.when(name.rlike("^#[0-9]{1,7}$"), F.substring(name, 2, 8).try_cast("int")).when(name.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substring(name, 3, 8), 16, 10).try_cast("int"))
        char = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.try_element_at(table, name))
        return F.coalesce(F.when(name != "", F.concat(char, F.substring(p, F.length(name) + 2, F.length(p)))), F.concat(F.lit("&"), p))

    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), resolved), ""))


def html_to_text(c: Column | str) -> Column:
    """Markup of simple fragments as text: no scripts, a line per block."""
    c = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?i)</(p|div|li|h[1-6]|tr|table|blockquote)>|<br\s*/?>", "\n")
    return normalise_text(unescape(F.regexp_replace(c, r"<[^>]+>", " ")))


def strip_html(c: Column | str) -> Column:
    """Tags as blanks, in one line."""
    return one_line(unescape(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"<[^>]+>", " ")))


def text_to_html(c: Column | str) -> Column:
    """Text as paragraphs of markup."""
    c = F.replace(F.replace(F.replace(col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = F.filter(F.split(c, r"\n{2,}"), lambda p: F.trim(p) != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(F.trim(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "\n")


def one_line(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def clean_title(c: Column | str, fallback: str = "") -> Column:
    """One line of at most 80 characters, an ellipsis for the rest."""
    c = F.coalesce(F.nullif(one_line(c), F.lit("")), F.lit(fallback))
    return F.when(F.length(c) > NO_TITLE_CHARS, F.concat(F.rtrim(F.substring(c, 1, NO_TITLE_CHARS - 1)), F.lit("…"))).otherwise(c)


def chat_title(c: Column | str, most: int = 60) -> Column:
    """The first line that is not empty, without marks of a heading, a label, quotes and a final stop; null if nothing is left."""
    first = F.get(F.filter(F.transform(F.split(col(c), r"\r\n|[\n\r]"), F.trim), lambda x: x != ""), F.lit(0))
    c = F.trim(F.regexp_replace(first, r"^#+", ""))
    c = F.trim(F.regexp_replace(c, r"(?iU)^(titel|title|überschrift)\s*:\s*", ""))
    c = F.trim(F.regexp_replace(c, r"^[*_]+|[*_]+$", ""))
    c = F.trim(F.regexp_replace(c, "^[\"'„“”‚‘’«»`]+|[\"'„“”‚‘’«»`]+$", ""))
    c = F.nullif(F.trim(F.regexp_replace(c, r"\.+$", "")), F.lit(""))
    cut = F.substring(c, 1, most - 1)
    cut = F.when(cut.contains(" "), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(cut, r"[ ,;:\-]+$", ""), F.lit("…"))).otherwise(c)


def snippet(c: Column | str, most: int = 500) -> Column:
    c = one_line(c)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most)), F.lit(" …"))).otherwise(c)


def clip(c: Column | str, most: int = 4000) -> Column:
    return F.substring(col(c), 1, most)


def path_name(c: Column | str, fallback: Column) -> Column:
    """A name fit for a path: no slash, single blanks, the fallback for none."""
    return F.coalesce(F.nullif(one_line(F.replace(F.coalesce(col(c), F.lit("")), F.lit("/"), F.lit("-"))), F.lit("")), fallback)


def raw_name(c: Column | str, fallback: Column) -> Column:
    return F.coalesce(F.nullif(one_line(c), F.lit("")), fallback)


def breadcrumb(path: Column | str) -> Column:
    return F.array_join(F.filter(col(path), lambda p: p.isNotNull() & (p != "")), HEADER_SEPARATOR)


def sentences(c: Column | str) -> Column:
    """Sentences of each paragraph, without empty ones."""
    # Few have blanks at their ends, and looking at these is cheaper than looking for them.
    outer = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
    strip = lambda x: F.when(F.rlike(outer(x), F.lit(r"(?U)\s")), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x)
    paragraphs = F.filter(F.transform(F.split(col(c), r"\n\n"), strip), lambda p: p != "")
    return F.filter(F.flatten(F.transform(paragraphs, lambda p: F.transform(F.split(p, r"(?<=[.!?:;])\s+"), strip))), lambda s: s != "")


def token_estimate(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(c)) / 4)).cast("long")


def doc_id_parts(c: Column | str) -> Column:
    """struct(course, cmid, part) of "course:cmid:part"; the part may hold colons."""
    p = F.split(col(c), ":", 3)
    return F.struct(F.get(p, F.lit(0)).cast("int").alias("course"), F.get(p, F.lit(1)).cast("int").alias("cmid"), F.get(p, F.lit(2)).alias("part"))


def thread_parts(c: Column | str) -> Column:
    """struct(owner, conversation, turn) of a thread id, split at its last two colons."""
    return F.struct(*(F.regexp_extract(col(c), r"^(.*):([^:]*):([^:]*)$", i + 1).alias(n) for i, n in enumerate(("owner", "conversation", "turn"))))


def size_label(pages: Column, chars: Column, skip: Column, version: Column) -> Column:
    """What a listing says about a file's size."""
    return F.when(skip.isNotNull(), F.lit("kein Text")).when(version.isNull(), F.lit("wird verarbeitet")).when(pages > 0, F.concat(pages.cast("string"), F.lit(" Seiten"))).otherwise(F.concat(F.coalesce(chars, F.lit(0)).cast("string"), F.lit(" Zeichen")))
