"""python -m webloom.cli URL FOLDER [--name value ...]: every setting is an option."""

from __future__ import annotations

import argparse
from dataclasses import fields
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from .config import Settings, combine, load_file

#: Options that switch a setting off.
OFF = {"external": "same_origin_only", "no_strip_params": "strip_params", "no_render_block_media": "render_block_media", "no_auto_throttle": "auto_throttle", "no_checkpoint_seen": "checkpoint_include_seen_when_mem", "no_warc_gzip": "warc_gzip", "warc_new": "warc_append"}
RENAMED = {"cookies_file": "--cookies", "allow_params": "--allow-param", "extra_headers": "--header"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="webloom", argument_default=argparse.SUPPRESS)
    out.add_argument("url")
    out.add_argument("folder")
    out.add_argument("--config", default=None)
    for f in fields(Settings):
        name = RENAMED.get(f.name, "--" + f.name.replace("_", "-"))
        if f.name in OFF.values():
            continue
        if isinstance(f.default, bool):
            out.add_argument(name, dest=f.name, action="store_true")
        elif f.name in ("allow_params", "extra_headers"):
            out.add_argument(name, dest=f.name, action="append")
        else:
            out.add_argument(name, dest=f.name, type=type(f.default) if f.default is not None else str)
    for option, setting in OFF.items():
        out.add_argument("--" + option.replace("_", "-"), dest=setting, action="store_false")
    return out


def parse(argv: list[str] | None = None) -> tuple[str, str, Settings]:
    given = vars(parser().parse_args(argv))
    url, folder, config = given.pop("url"), given.pop("folder"), given.pop("config")
    if urlsplit(url).scheme not in ("http", "https"):
        raise SystemExit(1)
    return url, folder, combine(load_file(config) if config else {}, given)


def main(argv: list[str] | None = None) -> None:
    from .plans import site
    from .sources import http, snapshot

    url, folder, s = parse(argv)
    try:
        s.refuse_unsupported()
    except ValueError as error:
        raise SystemExit(str(error)) from None
    spark = SparkSession.builder.appName("webloom").getOrCreate()
    bodies = http.http_fetch(s)
    pages = lambda wanted: snapshot.html_responses(bodies(wanted))
    robots = None
    if s.crawl and (s.respect_robots or s.sitemap_seed):
        parts = urlsplit(url)
        asked = spark.createDataFrame([(f"{parts.scheme}://{parts.netloc}/robots.txt",)], "url string")
        robots = bodies(asked).selectExpr(f"'{parts.netloc}' as host", "status", "decode(body, 'UTF-8') as body")
    if s.crawl:
        texts = lambda wanted: bodies(wanted).selectExpr("url", "decode(body, 'UTF-8') as body")
        site.mirror_site(spark, url, pages, bodies, folder, s, robots, texts)
    else:
        site.clone_page(spark, url, pages, bodies, folder, s)


if __name__ == "__main__":
    main()
