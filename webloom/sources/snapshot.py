"""Pages from a table instead of the network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def html_responses(responses: DataFrame) -> DataFrame:
    """(url, html) of responses (url, status, content_type, charset, body): HTML without an error."""
    kind = urls.media_type(F.col("content_type"))
    good = (F.col("status") < 400) & (kind.contains("text/html") | kind.contains("application/xhtml+xml"))
    charset = F.lower(F.regexp_extract("content_type", "(?i)charset=[\"']?([^\"'; ]+)", 1))
    latin = charset.isin("iso-8859-1", "latin-1", "latin1", "windows-1252")
    html = F.when(latin, F.decode("body", "ISO-8859-1")).when(charset.isin("utf-16", "utf16"), F.decode("body", "UTF-16")).otherwise(F.decode("body", "UTF-8"))
    return responses.where(good).select("url", html.alias("html"))


def from_pages(pages: DataFrame, strip: bool = True, allow: tuple[str, ...] = ()) -> Callable[[DataFrame], DataFrame]:
    """A crawl's page source over pages (page_id, url, html); of pages with one normalized URL the first id counts."""
    norm = urls.normalize_url(F.col("url"), strip, allow)
    known = pages.withColumn("norm", norm).groupBy("norm").agg(F.min_by("html", "page_id").alias("html"))

    def fetch(wanted: DataFrame) -> DataFrame:
        return known.join(wanted.select(F.col("url").alias("norm")), "norm", "left_semi").select(F.col("norm").alias("url"), "html")

    return fetch


def from_bodies(responses: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """An asset source over stored responses."""

    def fetch(wanted: DataFrame) -> DataFrame:
        return responses.join(wanted.select("url"), "url", "left_semi")

    return fetch
