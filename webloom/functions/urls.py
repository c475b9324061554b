"""URL functions as Column expressions; only ``join_url`` leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A query parameter whose name begins so is dropped.
TRACKING_PREFIXES = ("utm_", "gclid", "fbclid", "mc_", "yclid", "icid", "ref", "cmpid")

# A URL that begins so is not fetched (upper and lower case matter).
UNFETCHABLE = ("#", "mailto:", "tel:", "javascript:", "data:", "blob:")

# Page names with these endings keep their name.
PAGE_ENDINGS = (".html", ".htm", ".php", ".asp", ".aspx", ".jsp", ".jspx", ".cfm")

# Asset categories by content type and ending, first match first.
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".bmp", ".avif")
SCRIPT_ENDINGS = (".js", ".mjs")
FONT_ENDINGS = (".woff", ".woff2", ".ttf", ".otf", ".eot")
MEDIA_ENDINGS = (".mp4", ".webm", ".mp3", ".ogg", ".wav", ".m4a", ".mkv")
DATA_ENDINGS = (".json", ".webmanifest", ".map")

# Endings of content types; the first six come before any system table.
TYPE_ENDINGS = {
    "application/javascript": ".js",
    "text/javascript": ".js",
    "application/json": ".json",
    "image/svg+xml": ".svg",
    "font/woff2": ".woff2",
    "font/woff": ".woff",
    "application/manifest+json": ".webmanifest",
    "text/html": ".html",
    "text/css": ".css",
    "text/plain": ".txt",
    "text/csv": ".csv",
    "text/xml": ".xml",
    "application/xml": ".xsl",
    "application/pdf": ".pdf",
    "application/zip": ".zip",
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/bmp": ".bmp",
    "image/avif": ".avif",
    "image/vnd.microsoft.icon": ".ico",
    "audio/mpeg": ".mp3",
    "audio/x-wav": ".wav",
    "video/mp4": ".mp4",
    "video/webm": ".webm",
}

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    """Host and port as written; upper case stays."""
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def _unquoted(text: Column) -> Column:
    """Form decoding; a percent sign without two hex digits stands for itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _quoted(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def kept_query(text: Column, allow: Sequence[str] = ()) -> Column:
    """The query without tracking parameters, encoded anew in its order."""
    allowed = [a.lower() for a in allow]
    pairs = F.filter(F.split(text, "&"), lambda p: p != "")
    key = lambda p: _unquoted(F.substring_index(p, "=", 1))
    value = lambda p: F.when(F.instr(p, "=") > 0, _unquoted(F.substr(p, F.instr(p, "=") + 1))).otherwise("")

    def stays(p: Column) -> Column:
        name = F.lower(key(p))
        tracking = name.rlike("^(?:" + "|".join(TRACKING_PREFIXES) + ")")
        return name.isin(allowed) | ~tracking if allowed else ~tracking

    kept = F.transform(F.filter(pairs, stays), lambda p: F.concat(_quoted(key(p)), F.lit("="), _quoted(value(p))))
    return F.array_join(kept, "&")


def normalize_url(url: Column, strip: bool = True, allow: Sequence[str] = ()) -> Column:
    """Without fragment and, if asked for, without tracking parameters."""
    asked = query(url)
    kept = F.when(asked == "", "").otherwise(kept_query(asked, allow)) if strip else asked
    front = F.concat(
        F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""),
        F.when(netloc(url) != "", F.concat(F.lit("//"), netloc(url))).otherwise(""),
        path(url),
    )
    return F.concat(front, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def can_fetch(url: Column) -> Column:
    begins = "^(?U)\\s*(?:" + "|".join(UNFETCHABLE) + ")"
    return F.coalesce((url != "") & ~url.rlike(begins), F.lit(False))


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (netloc(a) == netloc(b))


def url_allowed(url: Column, base: Column, same_origin_only: bool = True, include: str | None = None, exclude: str | None = None) -> Column:
    """Patterns see the URL as it is, fragment and all."""
    out = same_origin(base, url) if same_origin_only else F.lit(True)
    if include:
        out = out & url.rlike(include)
    if exclude:
        out = out & ~url.rlike(exclude)
    return out


def sanitize_filename(name: Column) -> Column:
    out = F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
    out = F.when(out == "", "file").otherwise(out)
    return F.left(F.regexp_replace(out, r"^\.", "_"), F.lit(200))


def short_hash(url: Column) -> Column:
    return F.left(F.md5(url.cast("binary")), F.lit(8))


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def ending(name: Column) -> Column:
    """The last dot and what follows; leading dots begin no ending."""
    return F.regexp_extract(name, r"^(?:[\s\S]*/)?\.*[^/]*[^./][^/]*(\.[^./]*)$", 1)


def ending_of_type(content_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TYPE_ENDINGS.items() for x in pair])
    return F.try_element_at(table, media_type(content_type))


def category(asset_path: Column, content_type: Column) -> Column:
    kind, end = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(ending(asset_path))
    return (
        F.when(kind.startswith("image/") | end.isin(*IMAGE_ENDINGS), "img")
        .when(kind.startswith("text/css") | (end == ".css"), "css")
        .when(kind.contains("javascript") | end.isin(*SCRIPT_ENDINGS), "js")
        .when(kind.startswith("font/") | end.isin(*FONT_ENDINGS), "font")
        .when(kind.startswith("audio/") | kind.startswith("video/") | end.isin(*MEDIA_ENDINGS), "media")
        .when(kind.contains("json") | end.isin(*DATA_ENDINGS), "data")
        .otherwise("other")
    )


def site_root(base: Column) -> Column:
    return sanitize_filename(netloc(base))


def _segments(p: Column) -> Column:
    # A parent step would leave the site's folder, so it is made an ordinary name.
    return F.transform(F.filter(F.split(p, "/"), lambda s: s != ""), lambda s: F.when(s.isin(".", ".."), "_").otherwise(s))


def page_path(url: Column, base: Column) -> Column:
    """Where a page lies below the output root; the query plays no part."""
    p = F.when(path(url) == "", "/").otherwise(path(url))
    segments = _segments(p)
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    keeps = ~p.endswith("/") & F.lower(ending(last)).isin(*PAGE_ENDINGS)
    full = F.when(keeps, segments).otherwise(F.concat(segments, F.array(F.lit("index.html"))))
    return F.concat_ws("/", site_root(base), F.lit("pages"), F.array_join(full, "/"))


def asset_path(url: Column, base: Column, content_type: Column) -> Column:
    """Own host: assets/CATEGORY; other hosts: assets/vendor/HOST/CATEGORY."""
    p = path(url)
    name = F.substring_index(F.regexp_replace(p, "/+$", ""), "/", -1)
    name = F.when(name == "", "file").otherwise(name)
    end = ending(name)
    stem = F.left(name, F.length(name) - F.length(end))
    end = F.when(end != "", end).otherwise(F.coalesce(ending_of_type(content_type), F.lit("")))
    file = F.concat(sanitize_filename(stem), F.lit("_"), short_hash(url), end)
    kind = category(p, content_type)
    own = F.concat_ws("/", site_root(base), F.lit("assets"), kind, file)
    other = F.concat_ws("/", site_root(base), F.lit("assets/vendor"), sanitize_filename(netloc(url)), kind, file)
    return F.when(netloc(url) == netloc(base), own).otherwise(other)


def relative_path(target: Column, folder: Column) -> Column:
    """The way from ``folder`` to ``target``, both relative to one root."""
    a, b = F.split(target, "/"), F.filter(F.split(folder, "/"), lambda s: s != "")
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    shared = F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")
    up = F.array_repeat(F.lit(".."), (F.size(b) - shared).cast("int"))
    way = F.concat(up, F.slice(a, shared + 1, F.size(a)))
    return F.when(F.size(way) == 0, ".").otherwise(F.array_join(way, "/"))


def parent_folder(p: Column) -> Column:
    return F.regexp_replace(p, "/?[^/]*$", "")


def join_root_relative(base: Column, ref: Column) -> Column:
    """For references that begin with one slash and have no dot segments."""
    return F.concat(scheme(base), F.lit("://"), netloc(base), ref)


@F.pandas_udf(StringType())
def join_url(base: pd.Series, ref: pd.Series) -> pd.Series:
    """RFC 3986 resolution; null where the pair cannot be joined."""

    def one(b: str | None, r: str | None) -> str | None:
        try:
            return None if b is None or r is None else urljoin(b, r)
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref)], dtype=object)


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Digits, or an HTTP date less ``now`` (not below 0); else null."""
    text = F.trim(value)
    stamp = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]+,? *", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    wait = F.greatest(F.lit(0.0), stamp.cast("double") - now.cast("timestamp").cast("double"))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("double")).when(stamp.isNotNull(), wait)


def backoff_seconds(times: Column, most: float = 60.0) -> Column:
    return F.least(F.lit(most), F.pow(F.lit(2.0), F.least(times, F.lit(6))))
