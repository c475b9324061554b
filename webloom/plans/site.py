"""Whole jobs: clone one page, mirror a site."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import urls
from ..operators import assets as asset_ops
from ..operators import crawl as crawl_ops
from ..operators import export, html, policy, rewrite, state
from ..storage import materialize


def collect_assets(pages: DataFrame, fetch: asset_ops.FetchBodies, base: str, s: Settings, rules: DataFrame | None = None) -> DataFrame:
    """Assets of pages (page_id, url, html) and what their CSS needs."""
    found = html.page_references(pages, s.skip_js).where("kind != 'anchor'")
    wanted = found.where(urls.url_allowed(F.col("url"), F.lit(base), s.same_origin_only, s.include, s.exclude)).select("url").distinct()
    if rules is not None:
        wanted = policy.may_fetch(wanted, rules, s.user_agent)
    return asset_ops.with_css_dependencies(asset_ops.download(wanted, fetch, base, s), fetch, base, s)


def finished_files(pages: DataFrame, assets: DataFrame, page_map: DataFrame, base: str, s: Settings) -> DataFrame:
    """(local_path, url, body) of everything that the copy consists of."""
    asset_map = assets.select("url", "local_path")
    allow = tuple(sorted(s.allow_params))
    done = rewrite.rewrite_pages(pages, asset_map, page_map, base, s.strip_params, allow).select("local_path", "url", F.encode("html", "UTF-8").alias("body"))
    texts = asset_ops.decoded(assets)
    end = F.lower(urls.ending(F.col("local_path")))
    kinds = {"css": end == ".css"}
    if s.rewrite_js_urls or s.rewrite_js_ast:
        kinds["js"] = end.isin(".js", ".mjs")
    rest = F.lit(True)
    for kind, which in kinds.items():
        new = rewrite.rewrite_texts(texts.where(which).select("url", "local_path", "text"), asset_map, kind, loads_only=s.rewrite_js_ast and not s.rewrite_js_urls)
        new = new.join(assets.select("url", "body"), "url")
        done = done.union(new.select("local_path", "url", F.when(F.col("changed"), F.encode("text_out", "UTF-8")).otherwise(F.col("body"))))
        rest = rest & ~which
    return done.union(assets.where(rest).select("local_path", "url", "body"))


def write_site(spark: SparkSession, folder: str, base: str, files: DataFrame, pages: DataFrame, assets: DataFrame) -> None:
    """The files themselves, a Parquet table of them and the manifest beside it."""
    files.write.mode("overwrite").parquet(f"{folder}/files")
    written = export.export_files(spark.read.parquet(f"{folder}/files"), folder)
    written.agg(F.sum("bytes")).collect()
    site = urls_root(spark, base)
    # A manifest names every file of one site in one document, as its readers expect.
    data = state.manifest(base, pages.select(F.col("local_path").alias("path"), "seq"), assets.select(F.col("local_path").alias("path"), F.xxhash64("local_path").alias("seq")))
    state.write_json(spark, f"{folder}/{site}-manifest.json", data)


def urls_root(spark: SparkSession, base: str) -> str:
    return spark.range(1).select(urls.site_root(F.lit(base))).first()[0]


def clone_page(spark: SparkSession, url: str, fetch_pages: crawl_ops.Fetch, fetch_bodies: asset_ops.FetchBodies, folder: str, s: Settings) -> DataFrame:
    """One page with its assets; its links stay as they are."""
    s.refuse_unsupported()
    wanted = spark.createDataFrame([(url,)], "url string")
    pages = materialize(fetch_pages(wanted).select(F.lit(0).cast("long").alias("page_id"), "url", "html"), "clone")
    found = collect_assets(pages, fetch_bodies, url, s)
    none = spark.createDataFrame([], "url string, local_path string")
    files = materialize(finished_files(pages, found, none, url, s), "files")
    placed = pages.select(urls.page_path(F.col("url"), F.lit(url)).alias("local_path"), F.col("page_id").alias("seq"))
    write_site(spark, folder, url, files, placed, found)
    return files


def mirror_site(
    spark: SparkSession,
    url: str,
    fetch_pages: crawl_ops.Fetch,
    fetch_bodies: asset_ops.FetchBodies,
    folder: str,
    s: Settings,
    robots: DataFrame | None = None,
    sitemap_fetch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """A site's pages within the budget, their assets, and links between them made local.

    ``robots`` holds robots files (host, status, body).
    """
    s.refuse_unsupported()
    rules = policy.robots_rules(robots) if robots is not None and s.respect_robots else None
    named = None
    if s.sitemap_seed and robots is not None and sitemap_fetch:
        named = policy.sitemap_pages(policy.sitemap_addresses(robots), sitemap_fetch)
        named = named.where(urls.url_allowed(F.col("url"), F.lit(url), s.same_origin_only, s.include, s.exclude))
    checkpoint = s.checkpoint_file or f"{folder}/state"
    visited = crawl_ops.crawl(
        spark,
        [url],
        fetch_pages,
        s,
        (lambda rows: policy.may_fetch(rows, rules, s.user_agent)) if rules is not None else None,
        state.load_checkpoint(spark, checkpoint) if s.resume else None,
        lambda visited, frontier, depth: state.save_checkpoint(spark, checkpoint, visited, frontier, depth, start=url),
        named,
    )
    pages = visited.where("status = 'page'").select(F.col("seq").alias("page_id"), "url", "html")
    found = collect_assets(pages, fetch_bodies, url, s, rules)
    files = materialize(finished_files(pages, found, crawl_ops.page_map(visited, url), url, s), "files")
    placed = pages.select(urls.page_path(F.col("url"), F.lit(url)).alias("local_path"), F.col("page_id").alias("seq"))
    write_site(spark, folder, url, files, placed, found)
    return files
