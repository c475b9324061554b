"""One pass over a page: references with their places, and rewriting by splicing.

Text that no reference touches stays as it is, byte for byte.  Script and style
contents are raw text, as in the standard library's parser.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html import escape
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.texts import Resolve, fetchable
from .batches import flat_map

# Which links and tags name assets.
LINK_RELS = {"stylesheet", "icon", "apple-touch-icon", "shortcut icon", "manifest"}
PRELOAD_KINDS = {"style", "image", "font"}
SRC_TAGS = {"img", "source", "video", "audio", "track"}
SRCSET_TAGS = {"img", "source"}
REWRITTEN = {"img": ("src",), "source": ("src",), "video": ("src", "poster"), "audio": ("src",), "track": ("src",), "script": ("src",), "link": ("href",), "input": ("src",)}
#: Attributes that no longer hold once an address has changed.
DROPPED = {"integrity", "crossorigin", "referrerpolicy"}


@dataclass
class Piece:
    """A start tag, or the text of a style or script element."""

    start: int
    end: int
    tag: str
    attrs: dict[str, str]
    text: str | None = None


class Scanner(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.pieces, self.open = html, [], None
        self.lines = [0]
        for line in html.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(html)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        start = self._at()
        end = start + len(self.get_starttag_text() or "")
        values: dict[str, str] = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        self.pieces.append(Piece(start, end, tag, values))
        self.open = (tag, end) if tag in ("style", "script") else None

    def handle_endtag(self, tag: str) -> None:
        if self.open and self.open[0] == tag:
            start, end = self.open[1], self._at()
            self.pieces.append(Piece(start, end, f"{tag} text", {}, self.html[start:end]))
        self.open = None


def base_url(pieces: list[Piece], page_url: str) -> str:
    for p in pieces:
        if p.tag == "base" and p.attrs.get("href"):
            return join(page_url, p.attrs["href"]) or page_url
    return page_url


def join(base: str, ref: str) -> str | None:
    try:
        return urljoin(base, ref)
    except ValueError:
        return None


def references(html: str, page_url: str, skip_js: bool = False) -> list[tuple[str, int, str, str]]:
    """(kind, place, reference as written, absolute URL) of anchors and assets."""
    pieces = Scanner(html).pieces
    base = base_url(pieces, page_url)
    found: list[tuple[str, int, str]] = []
    for p in pieces:
        get = p.attrs.get
        if p.tag == "a" and "href" in p.attrs:
            found.append(("anchor", p.start, get("href")))
        if p.tag == "link" and "href" in p.attrs:
            rels = set(get("rel", "").lower().split())
            if "preload" in rels:
                wanted = get("as", "").lower() in PRELOAD_KINDS
            else:
                wanted = bool(rels & LINK_RELS)
            if wanted:
                found.append(("link", p.start, get("href")))
        if "src" in p.attrs and (p.tag in SRC_TAGS or p.tag == "input" and get("type", "").lower() == "image"):
            found.append(("src", p.start, get("src")))
        if p.tag == "video" and "poster" in p.attrs:
            found.append(("poster", p.start, get("poster")))
        if p.tag in SRCSET_TAGS and "srcset" in p.attrs:
            found += [("srcset", p.start, u) for u in texts.srcset_urls(get("srcset"))]
        if "style" in p.attrs:
            found += [("style_attr", p.start, u) for u in texts.css_urls(get("style"))]
        if p.tag == "style text":
            found += [("style", p.start, u) for u in texts.css_urls(p.text)]
        if p.tag == "script" and "src" in p.attrs and not skip_js:
            found.append(("script", p.start, get("src")))
    out = []
    for kind, place, ref in found:
        url = join(base, ref) if fetchable(ref) else None
        if url is not None:
            out.append((kind, place, ref, url))
    return out


def rewrite(html: str, page_url: str, asset: Resolve, page: Resolve | None = None) -> str:
    """``asset`` and ``page`` map absolute URLs to relative paths, or to None.

    ``page`` gets the URL without its fragment; the fragment is put back.  A
    base element goes, as relative paths would resolve against it.
    """
    pieces = Scanner(html).pieces
    base = base_url(pieces, page_url)

    def by(find: Resolve) -> Resolve:
        def resolve(ref: str) -> str | None:
            url = join(base, ref) if fetchable(ref) else None
            return None if url is None else find(url)

        return resolve

    def page_link(url: str) -> str | None:
        bare, fragment = urldefrag(url)
        new = page(bare)
        return None if new is None else f"{new}#{fragment}" if fragment else new

    to_asset, out, last = by(asset), [], 0
    for p in sorted(pieces, key=lambda x: x.start):
        new: str | None = None
        if p.text is not None:
            if p.tag == "style text":
                new = texts.rewrite_css(p.text, to_asset)
        elif p.tag == "base" and "href" in p.attrs:
            new = ""
        else:
            attrs = dict(p.attrs)
            for name in REWRITTEN.get(p.tag, ()):
                path = to_asset(attrs[name]) if name in attrs else None
                if path is not None:
                    attrs[name] = path
                    attrs = {k: v for k, v in attrs.items() if k not in DROPPED}
            if p.tag in SRCSET_TAGS and "srcset" in attrs:
                attrs["srcset"] = texts.rewrite_srcset(attrs["srcset"], to_asset)
            if attrs.get("style"):
                attrs["style"] = texts.rewrite_css(attrs["style"], to_asset)
            if p.tag == "a" and "href" in attrs and page:
                attrs["href"] = by(page_link)(attrs["href"]) or attrs["href"]
            if attrs != p.attrs:
                closing = "/>" if html[p.start : p.end].endswith("/>") else ">"
                new = f"<{p.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in attrs.items()) + closing
        if new is not None and p.start >= last:
            out += [html[last : p.start], new]
            last = p.end
    return "".join([*out, html[last:]])


def page_references(pages: DataFrame, skip_js: bool = False) -> DataFrame:
    """(page_id, page_url, kind, place, ref, url) of every page (page_id, url, html)."""

    def found(page_id: int | None, url: str | None, text: str | None) -> Iterator[tuple]:
        return ((page_id, url, *r) for r in references(text or "", url or "", skip_js))

    kept = pages.select(F.col("page_id").cast("long"), "url", "html")
    return flat_map(kept, found, "page_id long, page_url string, kind string, place long, ref string, url string")
