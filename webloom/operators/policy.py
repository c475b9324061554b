"""Robots rules, sitemaps and cookies as tables, and the joins that apply them."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import ship
from ..storage import materialize
from .batches import flat_map

RULES = "host string, agent string, allow boolean, prefix string, ord int, crawl_delay double"


def parse_robots(body: str) -> list[tuple[str, bool | None, str | None, int, float | None]]:
    """(agent, allow, prefix, order, crawl delay) of a robots file; a delay is a row of its own.

    Groups of agent lines share the rules below them; an empty disallow allows
    all.  Of groups for one agent the first counts.
    """
    rows, agents, in_rules, seen = [], [], False, set()
    order = 0
    for line in body.splitlines():
        line = line.partition("#")[0].strip()
        if not line:
            continue
        key, colon, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if in_rules:
                seen |= set(agents)
                agents, in_rules = [], False
            agents.append(value.lower())
        elif key in ("allow", "disallow", "crawl-delay") and agents:
            in_rules = True
            for agent in (a for a in agents if a not in seen):
                if key == "crawl-delay":
                    if value.replace(".", "", 1).isdigit():
                        rows.append((agent, None, None, order, float(value)))
                else:
                    allow = key == "allow" or not value
                    rows.append((agent, allow, unquote(value), order, None))
                order += 1
    return rows


def robots_rules(files: DataFrame) -> DataFrame:
    """Rules of robots files (host, status, body); errors and empty files have none."""
    good = files.where((F.col("status") < 400) & (F.col("body") != ""))
    return flat_map(good.select("host", "body"), lambda host, body: ((host, *r) for r in parse_robots(body)), RULES)


def may_fetch(wanted: DataFrame, rules: DataFrame, user_agent: str) -> DataFrame:
    """The rows of ``wanted`` (url, ...) that the rules allow.

    The agent is the user agent's text before the slash.  A host's first group
    for that agent counts, else its group for ``*``; in it the first rule whose
    prefix fits decides; without one the URL is allowed.  Percent escapes of
    rules and URLs are decoded alike.
    """
    agent = user_agent.split("/")[0].strip().lower()
    named = rules.where(F.col("allow").isNotNull()).withColumn("own", (F.col("agent") != "*") & F.lit(agent).contains(F.col("agent")))
    named = named.where("own or agent = '*'")
    groups = named.groupBy("host").agg(F.min_by("agent", F.struct((~F.col("own")).alias("general"), "ord", "agent")).alias("chosen"))
    named = named.join(groups, "host").where("agent = chosen").select(F.col("host").alias("__host"), "allow", "prefix", "ord")
    target = F.when(urls.path(F.col("url")) == "", "/").otherwise(urls.path(F.col("url")))
    target = F.concat(target, F.when(urls.query(F.col("url")) != "", F.concat(F.lit("?"), urls.query(F.col("url")))).otherwise(""))
    target = F.url_decode(F.replace(F.regexp_replace(target, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))
    keyed = wanted.select("url").distinct().select("url", urls.netloc(F.col("url")).alias("__host"), target.alias("__target"))
    hits = keyed.join(named, "__host").where(F.col("__target").startswith(F.col("prefix")))
    refused = hits.groupBy("url").agg(F.min(F.struct("ord", "allow")).alias("x")).where("not x.allow").select("url")
    return wanted.join(refused, "url", "left_anti")


def crawl_delay(rules: DataFrame, user_agent: str) -> DataFrame:
    """(host, crawl_delay) for the agent, else for ``*``."""
    agent = user_agent.split("/")[0].strip().lower()
    found = rules.where(F.col("crawl_delay").isNotNull() & ((F.col("agent") == "*") | F.lit(agent).contains(F.col("agent"))))
    return found.groupBy("host").agg(F.min_by("crawl_delay", F.struct((F.col("agent") == "*").alias("general"), "ord")).alias("crawl_delay"))


def sitemap_addresses(robots: DataFrame) -> DataFrame:
    """(host, url) of the ``Sitemap:`` lines of robots files (host, status, body)."""
    lines = robots.where("status = 200").select("host", F.explode(F.split("body", "\r\n|\r|\n")).alias("line"))
    return lines.where(F.col("line").rlike("(?i)^\\s*sitemap:")).select("host", F.trim(F.regexp_replace("line", "(?i)^\\s*sitemap:", "")).alias("url"))


def sitemap_entries(xml: str) -> tuple[str, list[str]]:
    """("index" or "urls", addresses) of a sitemap; image and video addresses are left out."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return "urls", []
    entries = [x.text.strip() for x in root.iterfind("{*}*/{*}loc") if x.text and x.text.strip()]
    return ("index" if root.tag.endswith("sitemapindex") else "urls"), entries


def sitemap_pages(start: DataFrame, fetch: Callable[[DataFrame], DataFrame], depth: int = 5) -> DataFrame:
    """(url) of all pages that sitemaps name, through indexes up to ``depth`` levels; cycles end.

    ``fetch`` answers (url, body) for (url).
    """
    spark = start.sparkSession
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(kind, e) for b in batch["body"] for kind, entries in [sitemap_entries(b or "")] for e in entries]
            yield pd.DataFrame(rows, columns=["kind", "url"])

    seen = todo = materialize(start.select("url").distinct(), "sitemaps")
    pages = spark.createDataFrame([], "url string")
    for _ in range(depth):
        found = materialize(fetch(todo).select("body").mapInPandas(run, "kind string, url string").distinct(), "sitemap-entries")
        pages = pages.union(found.where("kind = 'urls'").select("url"))
        todo = materialize(found.where("kind = 'index'").select("url").join(seen, "url", "left_anti"), "sitemaps")
        if todo.isEmpty():
            break
        seen = seen.union(todo)
    return pages.distinct()


def cookies_for(wanted: DataFrame, cookies: DataFrame) -> DataFrame:
    """(url, name, value, domain, path, secure) of the cookies that go with each URL.

    A cookie's domain equals the host or one of its parents, so the join is on
    equal domains; a longer path wins over a shorter one of the same name.
    """
    host = F.lower(F.regexp_replace(urls.netloc(F.col("url")), ":[0-9]+$", ""))
    labels = F.split(host, "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = wanted.select("url", host.alias("__host"), F.explode(parents).alias("__domain")).distinct()
    plain = F.lower(F.regexp_replace("domain", "^\\.", ""))
    found = keyed.join(cookies.withColumn("__domain", plain), "__domain")
    at = F.when(urls.path(F.col("url")) == "", "/").otherwise(urls.path(F.col("url")))
    found = found.where(at.startswith(F.coalesce("path", F.lit("/"))) & (~F.coalesce("secure", F.lit(False)) | (urls.scheme(F.col("url")) == "https")))
    found = found.where(F.col("domain").startswith(".") | (F.col("__host") == F.col("__domain")))
    best = Window.partitionBy("url", "name").orderBy(F.length("path").desc(), F.length("domain").desc(), "value")
    return found.withColumn("n", F.row_number().over(best)).where("n = 1").select("url", "name", "value", "domain", "path", "secure")
