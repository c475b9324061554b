"""Breadth-first crawl as rounds of joins over a page source.

A round takes the frontier of one depth in a fixed order (place of the parent,
place in the parent), drops what was seen, asks the source for the rest, keeps
as many pages as the budget allows, and expands them.  Each round's tables are
written, so a round never recomputes an earlier one and a crawl can go on from
its last round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import urls
from ..storage import materialize
from .html import page_references

#: Given frontier URLs (url), a source answers (url, html) for those that are pages.
Fetch = Callable[[DataFrame], DataFrame]

FRONTIER = "url string, parent long, place long"
VISITED = "url string, depth int, seq long, html string, status string"


def numbered(rows: DataFrame, order: list[str], first: int) -> DataFrame:
    """Adds ``seq``: consecutive numbers in the order given, without one task seeing all rows."""
    parts = materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = sorted((r["__part"], r["count"]) for r in parts.groupBy("__part").count().collect())
    starts, total = {}, first
    for part, size in sizes:
        starts[part] = total
        total += size
    if not starts:
        return parts.withColumn("seq", F.lit(0).cast("long")).drop("__part")
    offsets = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("seq", (offsets[F.col("__part")] + own).cast("long")).drop("__part")


def anchors_of(visited: DataFrame, base: str, s: Settings) -> DataFrame:
    """Normalized links of pages (url, html, seq): url, parent, place; the policy sees them unnormalized."""
    found = page_references(visited.select(F.col("seq").alias("page_id"), "url", "html")).where("kind = 'anchor'")
    allowed = urls.url_allowed(F.col("url"), F.lit(base), s.same_origin_only, s.include, s.exclude)
    norm = urls.normalize_url(F.col("url"), s.strip_params, sorted(s.allow_params))
    return found.where(allowed).select(norm.alias("url"), F.col("page_id").alias("parent"), F.col("place").cast("long").alias("place"))


def first_found(frontier: DataFrame) -> DataFrame:
    """One row per URL: where it was found first."""
    return frontier.groupBy("url").agg(F.min(F.struct("parent", "place")).alias("x")).select("url", "x.parent", "x.place")


def crawl(
    spark: SparkSession,
    seeds: list[str],
    fetch: Fetch,
    s: Settings,
    robots: Callable[[DataFrame], DataFrame] | None = None,
    resume: tuple[DataFrame, DataFrame, int] | None = None,
    on_round: Callable[[DataFrame, DataFrame, int], None] | None = None,
    named: DataFrame | None = None,
) -> DataFrame:
    """(url, depth, seq, html, status) of every URL that was taken up.

    ``robots`` keeps the rows that may be fetched.  ``resume`` is (visited,
    frontier, depth) of an earlier crawl; ``on_round`` gets the same after each
    round.  ``named`` (url) are further seeds, behind the others and by address;
    all are taken up, and the page budget alone ends them.  Pages count towards ``max_pages``; other answers do not.
    """
    if resume:
        visited, frontier, depth = resume
    else:
        rows = [(u, -1, i) for i, u in enumerate(dict.fromkeys(seeds))]
        frontier = spark.createDataFrame(rows, FRONTIER)
        if named is not None:
            more = numbered(named.select("url").distinct(), ["url"], len(rows))
            frontier = frontier.union(more.select("url", F.lit(-1).cast("long"), "seq"))
        frontier = first_found(frontier.withColumn("url", urls.normalize_url(F.col("url"), s.strip_params, sorted(s.allow_params))))
        visited, depth = spark.createDataFrame([], VISITED), 0
    base = seeds[0] if seeds else ""
    while True:
        done = visited.where("status = 'page'").count()
        todo = materialize(frontier.join(visited.select("url"), "url", "left_anti"), "frontier")
        if done >= s.max_pages or depth > s.max_depth or todo.isEmpty():
            return visited
        may = robots(todo) if robots else todo
        got = materialize(may.join(fetch(may.select("url")).withColumnRenamed("url", "__url"), F.col("url") == F.col("__url"), "left").drop("__url"), "fetched")
        order = ["parent", "place", "url"]
        pages = got.where("html is not null").orderBy(*order).limit(s.max_pages - done)
        pages = materialize(numbered(pages, order, done).select("url", F.lit(depth).alias("depth"), "seq", "html", F.lit("page").alias("status")), "pages")
        others = got.where("html is null").select("url", F.lit(depth).alias("depth"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("html"), F.lit("other").alias("status"))
        denied = todo.join(may.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("html"), F.lit("denied").alias("status"))
        visited = materialize(visited.unionByName(pages).unionByName(others).unionByName(denied), "visited")
        frontier = materialize(first_found(anchors_of(pages, base, s)), "found") if depth < s.max_depth else spark.createDataFrame([], FRONTIER)
        depth += 1
        if on_round:
            on_round(visited, frontier, depth)


def page_map(visited: DataFrame, base: str) -> DataFrame:
    """(url, local_path) of the pages that were fetched, for rewriting their links."""
    return visited.where("status = 'page'").select("url", urls.page_path(F.col("url"), F.lit(base)).alias("local_path"))
