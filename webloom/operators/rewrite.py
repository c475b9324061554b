"""Rewriting after the crawl: references join the asset and page maps, texts are spliced.

The maps are joined by URL and travel to each page as its own short list, so no
map is ever broadcast whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts, urls
from ..session import ship
from . import html


def link_targets(references: DataFrame, page_map: DataFrame, strip: bool = True, allow: tuple[str, ...] = ()) -> DataFrame:
    """Anchors with the local page that they lead to: references plus norm and target (null: none).

    ``page_map`` has (url, local_path), urls normalized, one row each.
    """
    anchors = references.where("kind = 'anchor'").withColumn("norm", urls.normalize_url(F.col("url"), strip, allow))
    return anchors.join(page_map.select(F.col("url").alias("norm"), F.col("local_path").alias("target")), "norm", "left")


def rewrite_pages(pages: DataFrame, asset_map: DataFrame, page_map: DataFrame, base: str, strip: bool = True, allow: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, local_path, html, changed) of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    own = F.col("own_folder")
    placed = pages.withColumn("local_path", urls.page_path(F.col("url"), F.lit(base)))
    folders = placed.select("page_id", urls.parent_folder(F.col("local_path")).alias("own_folder"))
    found = html.page_references(pages)
    assets = found.where("kind != 'anchor'").select("page_id", "url").distinct().join(asset_map.select("url", "local_path"), "url")
    assets = assets.select("page_id", F.lit("asset").alias("kind"), "url", "local_path")
    links = link_targets(found, page_map, strip, allow).where("target is not null")
    links = links.select("page_id", F.lit("page").alias("kind"), F.regexp_replace("url", "#[\\s\\S]*$", "").alias("url"), F.col("target").alias("local_path")).distinct()
    known = assets.union(links).join(folders, "page_id")
    known = known.withColumn("way", urls.relative_path(F.col("local_path"), own))
    lists = known.groupBy("page_id").agg(F.collect_list(F.struct("kind", "url", "way")).alias("known"))
    rows = placed.join(lists, "page_id", "left").select("page_id", "url", "local_path", "html", "known")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, url, path, text, known in batch.itertuples(index=False):
                maps: dict[str, dict] = {"asset": {}, "page": {}}
                for x in known if known is not None else ():
                    maps[x["kind"]][x["url"]] = x["way"]
                new = html.rewrite(text or "", url or "", maps["asset"].get, maps["page"].get)
                out.append((page_id, url, path, new, new != (text or "")))
            yield pd.DataFrame(out, columns=["page_id", "url", "local_path", "html", "changed"])

    return rows.mapInPandas(run, "page_id long, url string, local_path string, html string, changed boolean")


def rewrite_texts(files: DataFrame, asset_map: DataFrame, kind: str, loads_only: bool = False) -> DataFrame:
    """CSS or script files (url, local_path, text) with known references replaced; adds text_out, changed."""
    ship(files.sparkSession)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, text in zip(batch["url"], batch["text"]):
                refs = texts.css_urls(text or "") if kind == "css" else texts.script_urls(text or "", loads_only)
                rows += [(url, r, html.join(url, r)) for r in refs]
            yield pd.DataFrame(rows, columns=["url", "ref", "absolute"])

    refs = files.select("url", "text").mapInPandas(find, "url string, ref string, absolute string")
    hits = refs.join(asset_map.select(F.col("url").alias("absolute"), F.col("local_path").alias("target")), "absolute")
    hits = hits.join(files.select("url", urls.parent_folder(F.col("local_path")).alias("folder")), "url")
    hits = hits.withColumn("way", urls.relative_path(F.col("target"), F.col("folder")))
    lists = hits.groupBy("url").agg(F.collect_list(F.struct("ref", "way")).alias("known"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, path, text, known in batch.itertuples(index=False):
                ways = {x["ref"]: x["way"] for x in known} if known is not None else {}
                text = text or ""
                new = texts.rewrite_css(text, ways.get) if kind == "css" else texts.rewrite_script(text, ways.get, loads_only)
                if not ways:
                    new = text
                out.append((url, path, text, new, new != text))
            yield pd.DataFrame(out, columns=["url", "local_path", "text", "text_out", "changed"])

    rows = files.join(lists, "url", "left").select("url", "local_path", "text", "known")
    return rows.mapInPandas(put, "url string, local_path string, text string, text_out string, changed boolean")
