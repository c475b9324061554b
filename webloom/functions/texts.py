"""URLs inside CSS, srcset and script texts: finding them and putting others in their place.

``resolve`` maps a reference as written to its replacement, or to None to leave it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .urls import UNFETCHABLE

Resolve = Callable[[str], str | None]

# A relative script string with one of these endings is an address.
SCRIPT_ENDINGS = (
    "css", "gif", "ico", "jpeg", "jpg", "js", "json", "mjs", "mp3", "mp4", "ogg", "otf", "png", "svg", "ttf", "wav", "webm", "webmanifest", "webp", "woff", "woff2",
)

#: Strings that scripts load from: import, require, fetch, new Request, .open and .src or .href assignments.
SCRIPT_LOADS = re.compile(
    r"(?:\bimport\s*\(\s*|\b(?:import|from)\s+|\b(?:require|fetch)\s*\(\s*|\bnew\s+Request\s*\(\s*"
    r"|\.open\s*\(\s*[^,()]+,\s*|\.(?:src|href)\s*=\s*)([\"'])([^\"'\n]*)\1"
)


def fetchable(url: str | None) -> bool:
    return bool(url) and not url.strip().startswith(UNFETCHABLE)


def srcset_urls(value: str | None) -> list[str]:
    """The first word of each candidate; repeated ones stay."""
    return [c.split()[0] for c in re.split(r"\s*,\s*", (value or "").strip()) if c.strip()]


def _past_blanks(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _reference_at(text: str, at: int, stops: str) -> tuple[str, str, int] | None:
    """(quote, reference, end) of a reference, quoted or bare; a bare one ends before any of ``stops``."""
    quote = text[at] if text[at : at + 1] in ("'", '"') else ""
    end = begin = at + len(quote)
    while end < len(text) and text[end] not in stops:
        end += 1
    if end == begin or quote and text[end : end + 1] != quote:
        return None
    return quote, text[begin:end], end + len(quote)


@dataclass(frozen=True)
class CssReference:
    """``url(...)``, or a whole ``@import`` up to its semicolon."""

    start: int
    end: int
    quote: str
    ref: str
    imported: bool


def css_references(text: str) -> Iterator[CssReference]:
    """References by place; an import by ``url()`` comes as an import and as an address."""
    lower = text.lower()
    if len(lower) != len(text):  # some letters change their length
        lower = text
    places = sorted([(m, w) for w in ("url(", "@import") for m in _places(lower, w)])
    for start, word in places:
        at = _past_blanks(text, start + len(word))
        if word == "url(":
            found = _reference_at(text, at, "\"')")
            if found and text[(end := _past_blanks(text, found[2])) : end + 1] == ")":
                yield CssReference(start, end + 1, found[0], found[1].strip(), False)
            continue
        inner = lower.startswith("url(", at)
        found = _reference_at(text, _past_blanks(text, at + 4 * inner), "\"');")
        if found:
            end = _past_blanks(text, found[2])
            if inner and text[end : end + 1] == ")":
                end = _past_blanks(text, end + 1)
            if text[end : end + 1] == ";":
                yield CssReference(start, end + 1, found[0], found[1].strip(), True)


def _places(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def css_urls(text: str) -> list[str]:
    """Fetchable references, each once: those of url() first, then those of imports."""
    found = sorted(css_references(text), key=lambda r: r.imported)
    return [u for u in dict.fromkeys(r.ref for r in found) if fetchable(u)]


def is_address(content: str) -> bool:
    """Whether a script's string is an address: absolute, from the root, or relative with a known ending."""
    if content.startswith(("//", "http://", "https://")):
        return not content.endswith("//")
    if content.startswith("/"):
        return len(content) > 1 and not any(c.isspace() for c in content)
    stem, _, end = content.rpartition(".")
    return len(stem) > 1 and end in SCRIPT_ENDINGS and content[0] not in ":?#" and not content[0].isspace()


def script_strings(text: str) -> Iterator[tuple[int, int]]:
    """Where addresses between two equal quotes, with no quote inside, begin and end."""
    quotes = [i for i, c in enumerate(text) if c in "'\""]
    k = 0
    while k + 1 < len(quotes):
        start, end = quotes[k] + 1, quotes[k + 1]
        taken = text[start - 1] == text[end] and is_address(text[start:end])
        if taken:
            yield start, end
        k += 2 if taken else 1


def script_urls(text: str, loads_only: bool = False) -> list[str]:
    spans = (m.span(2) for m in SCRIPT_LOADS.finditer(text)) if loads_only else script_strings(text)
    return list(dict.fromkeys(text[a:b] for a, b in spans if b > a))


def rewrite_css(text: str, resolve: Resolve) -> str:
    """Imports come out as ``@import url(...)``."""
    out, last = [], 0
    for r in css_references(text):
        if r.start >= last:  # not inside an import
            new = f"url({r.quote}{resolve(r.ref) or r.ref}{r.quote})"
            out += [text[last : r.start], f"@import {new};" if r.imported else new]
            last = r.end
    return "".join([*out, text[last:]])


def rewrite_srcset(value: str, resolve: Resolve) -> str:
    out = []
    for candidate in re.split(r"\s*,\s*", value.strip()):
        words = candidate.split()
        if words:
            out.append(" ".join([resolve(words[0]) or words[0], *words[1:]]))
    return ", ".join(out)


def rewrite_script(text: str, resolve: Resolve, loads_only: bool = False) -> str:
    """``loads_only`` touches just the strings that a script loads from."""

    out, last = [], 0
    for a, b in (m.span(2) for m in SCRIPT_LOADS.finditer(text)) if loads_only else script_strings(text):
        new = resolve(text[a:b])
        if new is not None:
            out += [text[last:a], new]
            last = b
    return "".join([*out, text[last:]])
