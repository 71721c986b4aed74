"""URL rules of the external sources, on columns; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(c: Column | str, part: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.try_parse_url(c, F.lit(part))


def host(c: Column | str) -> Column:
    return F.lower(_part(c, "HOST"))


def origin(c: Column | str) -> Column:
    """scheme://host[:port] in lower case without default ports; null for anything but http."""
    c = F.col(c) if isinstance(c, str) else c
    scheme, name = F.lower(F.regexp_extract(c, r"^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(c, r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    port = F.regexp_extract(c, r"^[A-Za-z]+://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/:?#]*):(\d+)", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(scheme.isin("http", "https") & (name != ""), F.concat(scheme, F.lit("://"), name, F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port))))


def normalised(c: Column | str) -> Column:
    """Stripped, no final slash; null if it is no absolute http URL."""
    c = F.rtrim(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("/"))
    return F.when(c.rlike(r"^https?://[^/\s]+"), c)


def youtube_id(c: Column | str) -> Column:
    watch = host(c).isin("youtube.com", "www.youtube.com", "m.youtube.com") & (_part(c, "PATH") == "/watch")
    c_ = F.col(c) if isinstance(c, str) else c
    return F.when(watch, F.nullif(F.try_parse_url(c_, F.lit("QUERY"), F.lit("v")), F.lit(""))).when(host(c) == "youtu.be", F.nullif(F.trim(_part(c, "PATH"), F.lit("/")), F.lit("")))


def hackmd_export(c: Column | str) -> Column:
    """The Markdown of a note: query and fragment dropped, .md appended once."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.rtrim(F.regexp_replace(c, r"[?#].*$", ""), F.lit("/"))
    return F.when((host(c) == "hackmd.io") & bare.rlike(r"^https?://[^/]+/."), F.when(bare.endswith(".md"), bare).otherwise(F.concat(bare, F.lit(".md"))))


#: What each product of Google's editors is exported as, and the kind of the result.
EXPORTS = {"document": ("export?format=txt", "text"), "presentation": ("export/pptx", "pptx"), "spreadsheets": ("export?format=xlsx", "xlsx")}


def google_export(c: Column | str) -> Column:
    """struct(url, kind), or null for other URLs."""
    p = F.split(_part(c, "PATH"), "/")
    product, doc = F.get(p, F.lit(1)), F.get(p, F.lit(3))
    ok = (host(c) == "docs.google.com") & (F.get(p, F.lit(2)) == "d") & (doc != "")
    out = F.lit(None)
    for name, (suffix, kind) in EXPORTS.items():
        found = F.struct(F.concat(F.lit(f"https://docs.google.com/{name}/d/"), doc, F.lit(f"/{suffix}")).alias("url"), F.lit(kind).alias("kind"))
        out = F.when(ok & (product == name), found).otherwise(out)
    return out


def share_download(c: Column | str) -> Column:
    """A public share's direct download, query dropped; null for other URLs."""
    c = F.col(c) if isinstance(c, str) else c
    at = r"^(https?://[^/?#]+(?:/index\.php)?/s/[A-Za-z0-9_\-]{4,})/?(?:[?#].*)?$"
    return F.when(c.rlike(at), F.concat(F.regexp_extract(c, at, 1), F.lit("/download")))


def board_id(c: Column | str) -> Column:
    """The id of a board, which stands in the path or in the fragment."""
    c = F.col(c) if isinstance(c, str) else c
    on = host(c).endswith("taskcards.app") | host(c).isin("taskcards.de", "www.taskcards.de")
    return F.when(on, F.nullif(F.regexp_extract(c, r"/board/([0-9a-fA-F\-]{36})", 1), F.lit("")))


def share_token(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(c, r"[?&]token=([^&#]+)", 1), F.lit(""))


def source_kind(c: Column | str) -> Column:
    """Which connector takes a URL: null for none (skipped), 'error' for anything but http."""
    c = F.col(c) if isinstance(c, str) else c
    return (
        F.when(~c.rlike(r"(?i)^https?://"), F.lit("error"))
        .when(youtube_id(c).isNotNull(), F.lit("youtube"))
        .when(board_id(c).isNotNull(), F.lit("taskcards"))
        .when(hackmd_export(c).isNotNull(), F.lit("hackmd"))
        .when(google_export(c).isNotNull(), F.lit("google"))
        .when(share_download(c).isNotNull(), F.lit("nextcloud"))
    )


def download_outcome(status: Column | str) -> Column:
    """What an HTTP status means for a download: ok, rate-limited, retry or permanent."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s.between(200, 299), F.lit("ok")).when(s.isin(429, 503), F.lit("rate-limited")).when(s.isin(408, 425, 500, 502, 504), F.lit("retry")).otherwise(F.lit("permanent"))
