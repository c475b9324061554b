"""Assets: what pages refer to, what was fetched, where it goes, and what CSS refers to in turn."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import texts, urls
from ..session import ship
from ..storage import materialize
from . import html

#: Given URLs (url), answers (url, status, content_type, content_length, body).
FetchBodies = Callable[[DataFrame], DataFrame]


def accepted(responses: DataFrame, s: Settings) -> DataFrame:
    """Responses that are kept: no error, declared and real size within the limit, not empty."""
    declared = F.col("content_length").cast("string").try_cast("long")
    size = F.length("body")
    return responses.where((F.col("status") < 400) & (declared.isNull() | (declared <= s.max_bytes)) & (size > 0) & (size <= s.max_bytes))


def download(wanted: DataFrame, fetch: FetchBodies, base: str, s: Settings) -> DataFrame:
    """(url, local_path, category, content_type, body) of the distinct URLs that could be had."""
    got = accepted(fetch(wanted.select("url").distinct()), s)
    kind = F.coalesce(F.col("content_type"), F.lit(""))
    return got.select(
        "url",
        urls.asset_path(F.col("url"), F.lit(base), kind).alias("local_path"),
        urls.category(urls.path(F.col("url")), kind).alias("category"),
        "content_type",
        "body",
    )


def decoded(files: DataFrame) -> DataFrame:
    """Adds ``text``: UTF-8 without what is no UTF-8."""
    return files.withColumn("text", F.regexp_replace(F.decode("body", "UTF-8"), "�", ""))


def css_references(files: DataFrame) -> DataFrame:
    """(css_url, url) of what CSS files (url, text) refer to."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, html.join(u, r)) for u, t in zip(batch["url"], batch["text"]) for r in texts.css_urls(t or "")]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["css_url", "url"])

    return files.select("url", "text").mapInPandas(run, "css_url string, url string").distinct()


def with_css_dependencies(assets: DataFrame, fetch: FetchBodies, base: str, s: Settings, passes: int = 2) -> DataFrame:
    """Assets and what their CSS files refer to, ``passes`` rounds deep."""
    known = materialize(assets, "assets")
    fresh = known
    for _ in range(passes):
        css = decoded(fresh.where(F.lower(urls.ending(F.col("local_path"))) == ".css"))
        wanted = css_references(css).select("url").distinct().join(known.select("url"), "url", "left_anti")
        wanted = wanted.where(urls.url_allowed(F.col("url"), F.lit(base), s.same_origin_only, s.include, s.exclude))
        fresh = materialize(download(wanted, fetch, base, s), "css-assets")
        if fresh.isEmpty():
            break
        known = materialize(known.unionByName(fresh), "assets")
    return known
