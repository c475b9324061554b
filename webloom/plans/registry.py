"""Named queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import urls
from ..operators import assets as asset_ops
from ..operators import crawl, html, policy, rewrite, state, throttle, warc_rows
from ..sources import snapshot
from ..storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# --- SQL building blocks ------------------------------------------------------

PARTS = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$'"


def part(column: str, group: int) -> str:
    return f"regexp_extract({column}, {PARTS}, {group})"


def sql_norm(column: str) -> str:
    prefixes = "|".join(urls.TRACKING_PREFIXES)
    kept = f"array_to_string(list_filter(string_split({part(column, 4)}, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:{prefixes})')), '&')"
    return f"(lower({part(column, 1)}) || '://' || {part(column, 2)} || {part(column, 3)} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END)"


def sql_sanitized(column: str) -> str:
    return f"regexp_replace({column}, '[<>:\"/\\\\|?*]', '_', 'g')"


def sql_page_path(column: str) -> str:
    segments = f"list_filter(string_split({part(column, 3)}, '/'), lambda s: s <> '')"
    endings = "|".join(e[1:] for e in urls.PAGE_ENDINGS)
    named = f"(NOT ends_with({part(column, 3)}, '/') AND regexp_matches(lower({part(column, 3)}), '[^/.][^/]*[.](?:{endings})$'))"
    return f"({sql_sanitized(part(column, 2))} || '/pages/' || CASE WHEN {named} THEN array_to_string({segments}, '/') ELSE array_to_string(list_append({segments}, 'index.html'), '/') END)"


ANCHORS = r"""anchors AS (
  SELECT page_id, page_url, ref, regexp_extract(page_url, '^[^:]+://[^/?#]*') || ref AS url
  FROM (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS ref FROM pages)
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.page_references(table(spark, sf_dir, "pages"))
    return found.where("kind = 'anchor'").select("page_id", "page_url", "place", "ref", "url")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


# --- scalar functions ---------------------------------------------------------


@query(f"SELECT page_id, {sql_norm('url')} AS norm FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("norm"))


@query(f"SELECT page_id, lower({part('url', 1)}) AS scheme, {part('url', 2)} AS netloc, {part('url', 3)} AS path, {part('url', 4)} AS query, {part('url', 5)} AS fragment FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("netloc"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.fragment(u).alias("fragment"))


@query(f"SELECT page_id, {sql_page_path('url')} AS local_path FROM pages")
def page_local_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.page_path(F.col("url"), F.col("url")).alias("local_path"))


@query(f"SELECT {sql_page_path('url')} AS local_path, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1 HAVING count(*) > 1")
def page_path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = page_local_path(spark, sf_dir)
    return placed.groupBy("local_path").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


@query(f"""SELECT lower(split_part(p, '=', 1)) AS param, count(*) AS n, regexp_matches(lower(split_part(p, '=', 1)), '^(?:{"|".join(urls.TRACKING_PREFIXES)})') AS dropped
FROM (SELECT unnest(string_split({part("url", 4)}, '&')) AS p FROM pages) WHERE p <> '' GROUP BY ALL""")
def tracking_param_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "pages").select(F.explode(F.split(urls.query(F.col("url")), "&")).alias("p")).where("p != ''")
    name = F.lower(F.substring_index("p", "=", 1))
    dropped = name.rlike("^(?:" + "|".join(urls.TRACKING_PREFIXES) + ")")
    return pairs.groupBy(name.alias("param")).agg(F.count("*").alias("n"), F.first(dropped).alias("dropped"))


@query(f"SELECT page_id, left(md5(url), 8) AS hash, left({sql_sanitized('url')}, 200) AS name FROM pages")
def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.short_hash(u).alias("hash"), urls.sanitize_filename(u).alias("name"))


FETCHABLE = [("#top",), ("mailto:a@b.example",), ("tel:1",), ("javascript:void(0)",), ("JavaScript:void(0)",), ("data:,x",), ("blob:x",), (" #x",), ("/a",), ("https://h.example/",), ("",), ("  ",)]


@query(f"SELECT url, url <> '' AND NOT regexp_matches(url, '^\\s*(?:{'|'.join(urls.UNFETCHABLE)})') AS ok FROM {sql_values(FETCHABLE, 'url')}")
def fetchable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, FETCHABLE, "url string").select("url", urls.can_fetch(F.col("url")).alias("ok"))


ASSETS = [
    ("https://h.example/i/a.PNG", ""),
    ("https://h.example/i/a", "image/webp"),
    ("https://h.example/s/x.css?v=1", "text/css; charset=utf-8"),
    ("https://cdn.example/lib.min.js", "application/javascript"),
    ("https://cdn.example/f", "font/woff2"),
    ("https://h.example:8080/v.mp4", "video/mp4"),
    ("https://h.example/d.webmanifest", "application/manifest+json"),
    ("https://h.example/d", "application/json"),
    ("https://h.example/", "text/plain"),
    ("https://h.example/b/.hidden", ""),
]
_SQL_CATEGORY = """CASE WHEN starts_with(ct, 'image/') OR regexp_matches(p, '[.](?:png|jpg|jpeg|gif|webp|svg|ico|bmp|avif)$') THEN 'img'
  WHEN starts_with(ct, 'text/css') OR ends_with(p, '.css') THEN 'css'
  WHEN contains(ct, 'javascript') OR regexp_matches(p, '[.]m?js$') THEN 'js'
  WHEN starts_with(ct, 'font/') OR regexp_matches(p, '[.](?:woff|woff2|ttf|otf|eot)$') THEN 'font'
  WHEN starts_with(ct, 'audio/') OR starts_with(ct, 'video/') OR regexp_matches(p, '[.](?:mp4|webm|mp3|ogg|wav|m4a|mkv)$') THEN 'media'
  WHEN contains(ct, 'json') OR regexp_matches(p, '[.](?:json|webmanifest|map)$') THEN 'data' ELSE 'other' END"""


@query(f"SELECT url, {_SQL_CATEGORY} AS category FROM (SELECT url, lower(ct) AS ct, lower({part('url', 3)}) AS p FROM {sql_values(ASSETS, 'url, ct')})")
def asset_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, ASSETS, "url string, ct string").select("url", urls.category(urls.path(F.col("url")), F.col("ct")).alias("category"))


_TYPE_CASE = "CASE trim(split_part(ct, ';', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in urls.TYPE_ENDINGS.items()) + " ELSE '' END"


@query(f"""WITH a AS (SELECT url, lower(ct) AS ct, lower({part("url", 3)}) AS p, {part("url", 3)} AS path, {part("url", 2)} AS host FROM {sql_values(ASSETS, "url, ct")}),
b AS (SELECT *, {_SQL_CATEGORY} AS cat, coalesce(nullif(regexp_extract(path, '([^/]*)/*$', 1), ''), 'file') AS name FROM a),
c AS (SELECT *, regexp_extract(name, '^[.]*[^.].*([.][^.]*)$', 1) AS ext FROM b),
d AS (SELECT *, left(name, length(name) - length(ext)) AS stem, CASE WHEN ext <> '' THEN ext ELSE {_TYPE_CASE} END AS full_ext FROM c)
SELECT url, 'h.example/assets/' || CASE WHEN host = 'h.example' THEN '' ELSE 'vendor/' || {sql_sanitized("host")} || '/' END || cat || '/' || regexp_replace(stem, '^[.]', '_') || '_' || left(md5(url), 8) || full_ext AS local_path FROM d""")
def asset_local_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, ASSETS, "url string, ct string")
    return rows.select("url", urls.asset_path(F.col("url"), F.lit("https://h.example/start"), F.col("ct")).alias("local_path"))


RETRY = [("120",), (" 7 ",), ("Thu, 01 Jan 1970 00:02:00 GMT",), ("junk",), ("",)]


@query(f"SELECT value, CASE WHEN trim(value) IN ('120', '7') THEN trim(value)::DOUBLE WHEN value LIKE '%1970%' THEN 20.0 END AS seconds FROM {sql_values(RETRY, 'value')}")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.timestamp_seconds(F.lit(100))
    return values(spark, RETRY, "value string").select("value", urls.retry_after_seconds(F.col("value"), now).alias("seconds"))


# --- links --------------------------------------------------------------------


@query(f"WITH {ANCHORS} SELECT page_id, ref, url, count(*) AS n FROM anchors GROUP BY ALL")
def anchor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).groupBy("page_id", "ref", "url").agg(F.count("*").alias("n"))


@query(f"WITH {ANCHORS} SELECT DISTINCT {sql_norm('url')} AS url FROM anchors")
def anchor_links_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).select(urls.normalize_url(F.col("url")).alias("url")).distinct()


@query(f"WITH {ANCHORS} SELECT {part('page_url', 2)} AS host, count(DISTINCT page_id) AS n_pages, count(*) AS n_links, count(DISTINCT url) AS n_targets FROM anchors GROUP BY 1")
def host_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: native extraction, resolution and counts per host."""
    pages = table(spark, sf_dir, "pages")
    refs = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    found = pages.select("page_id", "url", F.explode(refs).alias("ref")).where(urls.can_fetch(F.col("ref")))
    host = urls.netloc(F.col("url"))
    target = urls.join_root_relative(F.col("url"), F.col("ref"))
    return found.groupBy(host.alias("host")).agg(F.count_distinct("page_id").alias("n_pages"), F.count("*").alias("n_links"), F.count_distinct(target).alias("n_targets"))


@query(f"""WITH {ANCHORS}, m AS (SELECT DISTINCT {sql_norm("url")} AS norm FROM anchors)
SELECT page_id, ref, count(*) AS n, max(CASE WHEN m.norm IS NULL THEN NULL ELSE {sql_page_path("m.norm")} END) AS target
FROM anchors LEFT JOIN m ON m.norm = {sql_norm("anchors.url")} GROUP BY page_id, ref""")
def link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors against the map of all pages that they name."""
    found = links(spark, sf_dir).withColumn("kind", F.lit("anchor"))
    known = found.select(urls.normalize_url(F.col("url")).alias("url")).distinct()
    known = known.select("url", urls.page_path(F.col("url"), F.col("url")).alias("local_path"))
    return rewrite.link_targets(found, known).groupBy("page_id", "ref").agg(F.count("*").alias("n"), F.max("target").alias("target"))


@query(f"""WITH {ANCHORS} SELECT page_id, count(*) AS n, CAST(sum(CAST({part("url", 1)} = {part("page_url", 1)} AND {part("url", 2)} = {part("page_url", 2)} AND regexp_matches(url, 'e') AND NOT regexp_matches(url, 'th$') AS INT)) AS BIGINT) AS allowed FROM anchors GROUP BY 1""")
def url_allowed_same_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = urls.url_allowed(F.col("url"), F.col("page_url"), True, "e", "th$")
    return links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("allowed"))


@query(f"WITH {ANCHORS} SELECT {sql_norm('url')} AS url, 1 AS depth, count(DISTINCT page_id) AS parents, min(page_id) AS first_parent FROM anchors WHERE {sql_norm('url')} NOT IN (SELECT {sql_norm('url')} FROM pages) GROUP BY 1")
def frontier_round1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first round of a crawl from all pages would ask for."""
    seen = table(spark, sf_dir, "pages").select(urls.normalize_url(F.col("url")).alias("url"))
    found = links(spark, sf_dir).withColumn("url", urls.normalize_url(F.col("url"))).join(seen, "url", "left_anti")
    return found.groupBy("url").agg(F.lit(1).alias("depth"), F.count_distinct("page_id").alias("parents"), F.min("page_id").alias("first_parent"))


@query(f"""WITH {ANCHORS}, s AS (SELECT page_id, url, html, {sql_norm("url")} AS norm FROM pages WHERE url IN (SELECT min(url) FROM pages)),
o AS (SELECT DISTINCT {sql_norm("a.url")} AS url FROM anchors a JOIN s ON a.page_id = s.page_id WHERE {sql_norm("a.url")} NOT IN (SELECT norm FROM s))
SELECT norm AS url, 0 AS depth, 'page' AS status FROM s UNION ALL
SELECT url, 1, CASE WHEN url IN (SELECT {sql_norm("url")} FROM pages) THEN 'page' ELSE 'other' END FROM o""")
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl over the snapshot from the page with the smallest URL."""
    pages = table(spark, sf_dir, "pages")
    seed = pages.agg(F.min("url")).first()[0]
    # No crawl of a table has more pages than its rows: the budget cuts nothing.
    visited = crawl.crawl(spark, [seed], snapshot.from_pages(pages), Settings(crawl=True, max_depth=3, max_pages=pages.count() + 1))
    return visited.select("url", "depth", "status")


@query(f"""WITH p AS (SELECT page_id, {sql_page_path("url")} AS path FROM pages) SELECT path, min(page_id) AS seq FROM p GROUP BY path""")
def manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = page_local_path(spark, sf_dir).select(F.col("local_path").alias("path"), F.col("page_id").alias("seq"))
    return state.ordered_distinct(placed)


@query(f"SELECT {sql_norm('url')} AS url, max(page_id) AS page_id FROM pages GROUP BY 1")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written one after another under their normalized URLs: the last one stays."""
    pages = table(spark, sf_dir, "pages").select(urls.normalize_url(F.col("url")).alias("url"), "page_id")
    cut = pages.agg(F.max("page_id")).first()[0] // 2
    last = lambda rows: rows.groupBy("url").agg(F.max("page_id").alias("page_id"))
    return state.upsert(last(pages.where(F.col("page_id") <= cut)), last(pages.where(F.col("page_id") > cut)))


@query(f"""SELECT page_id, 'request' AS record_type, 'GET ' || CASE WHEN {part("url", 3)} = '' THEN '/' ELSE {part("url", 3)} END || CASE WHEN {part("url", 4)} <> '' THEN '?' || {part("url", 4)} ELSE '' END || ' HTTP/1.1' AS http_line, {part("url", 2)} AS host, 0 AS n_bytes FROM pages
UNION ALL SELECT page_id, 'response', 'HTTP/1.1 200 OK', NULL, octet_length(encode(html)) FROM pages""")
def warc_rows_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast(warc_rows.HEADERS)
    responses = table(spark, sf_dir, "pages").select(
        "page_id", F.col("html").isNull().alias("lost"), "url", F.lit("GET").alias("method"), F.lit(200).alias("status"), F.lit("OK").alias("reason"), F.encode("html", "UTF-8").alias("body"),
        none.alias("request_headers"), none.alias("headers"), F.lit(None).cast("binary").alias("request_body"),
    )
    rows = warc_rows.request_response_rows(responses, ("page_id", "lost"))
    asked = F.col("record_type") == "request"
    host = F.when(asked, F.coalesce(F.get("headers", F.lit(0))["v"], urls.netloc(F.col("url"))))
    return rows.select("page_id", "record_type", "http_line", host.alias("host"), F.when(asked | ~F.col("lost"), F.length("payload")).alias("n_bytes"))


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: webl\nAllow: /%74ha\nDisallow: /th\nDisallow: /%61\n\nUser-agent: webloom\nDisallow: /\n\nUser-agent: *\nDisallow: /\nCrawl-delay: 2\n"


@query(f"WITH {ANCHORS} SELECT page_id, ref, count(*) AS n FROM anchors WHERE starts_with(ref, '/tha') OR NOT (starts_with(ref, '/th') OR starts_with(ref, '/a')) GROUP BY 1, 2")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that one robots file, put on every host, lets through."""
    found = links(spark, sf_dir)
    files = found.select(urls.netloc(F.col("url")).alias("host"), F.lit(200).alias("status"), F.lit(ROBOTS).alias("body")).distinct()
    rules = materialize(policy.robots_rules(files), "rules")
    return policy.may_fetch(found, rules, "webloom/1.0").groupBy("page_id", "ref").agg(F.count("*").alias("n"))


COOKIES = [(".example.com", "/", False, "a", "1"), ("site0.example.com", "/", False, "b", "2"), (".example.org", "/", False, "c", "3"), (".com", "/x", False, "d", "4")]


@query(f"""SELECT page_id, name FROM pages, {sql_values([(d, p, n) for d, p, _, n, _ in COOKIES], "domain, cpath, name")}
WHERE CASE WHEN starts_with(domain, '.') THEN ends_with('.' || {part("url", 2)}, domain) ELSE {part("url", 2)} = domain END AND starts_with({part("url", 3)}, cpath)""")
def cookies_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    cookies = values(spark, COOKIES, "domain string, path string, secure boolean, name string, value string")
    return policy.cookies_for(pages, cookies).join(pages, "url").select("page_id", "name")


# --- assets and responses -----------------------------------------------------

DRESS = [
    ("link", "<link rel=stylesheet href='/s/%.css'>", "/s/%.css"),
    ("link", "<link rel=preload as=script href='/s/%.js'>", None),
    ("src", '<img src="/i/%.png" alt=x>', "/i/%.png"),
    ("src", "<img src='data:image/png;base64,%'>", None),
    ("src", "<input type=image src=/i/%-in.gif>", "/i/%-in.gif"),
    ("poster", '<video poster="/v/%.jpg"></video>', "/v/%.jpg"),
    ("srcset", '<source srcset="/i/%-1.webp 1x, /i/%-2.webp 2x">', "/i/%-1.webp"),
    ("srcset", "", "/i/%-2.webp"),
    ("style_attr", "<p style=\"background:url('/b/%.png')\">", "/b/%.png"),
    ("style", "<style>@import '/s/%-i.css'; a{b:url( /b/%-u.svg )}</style>", "/b/%-u.svg"),
    ("style", "", "/s/%-i.css"),
    ("script", "<script src=/s/%.mjs></script>", "/s/%.mjs"),
    ("anchor", "<script>'<a href=\"/no/%\">'</script><!-- <img src=/no/%.png> -->", None),
]


@query(f"""SELECT page_id, kind, regexp_extract(url, '^[^:]+://[^/?#]*') || replace(want, '%', page_id::VARCHAR) AS url
FROM pages, {sql_values([(k, w) for k, _, w in DRESS if w], "kind, want")}""")
def dressed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of every page, each page dressed with one of every kind."""
    dress = F.replace(F.lit("".join(h for _, h, _ in DRESS)), F.lit("%"), F.col("page_id").cast("string"))
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat(dress, F.coalesce("html", F.lit(""))))
    return html.page_references(pages).where("kind != 'anchor'").select("page_id", "kind", "url")


RESPONSES = [
    (1, 200, "text/html; charset=utf-8", None, 10), (2, 404, "text/html", None, 10), (3, 200, "application/xhtml+xml", "10", 10), (4, 200, "image/png", "2000", 10),
    (5, 200, "TEXT/HTML", "x", 1024), (6, 200, "text/css", None, 1025), (7, 204, "text/plain", None, 0), (8, None, None, None, 5), (9, 399, "", "1024", 1),
]


def responses(spark: SparkSession) -> DataFrame:
    rows = values(spark, RESPONSES, "id int, status int, content_type string, content_length string, n int")
    return rows.withColumn("url", F.concat(F.lit("http://h/"), F.col("id").cast("string"))).withColumn("body", F.repeat(F.lit("x"), F.col("n")).cast("binary"))


@query(f"SELECT id FROM {sql_values(RESPONSES, 'id, status, ct, declared, n')} WHERE status < 400 AND regexp_matches(lower(split_part(ct, ';', 1)), 'text/html|application/xhtml[+]xml')")
def html_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.html_responses(responses(spark)).select(F.regexp_extract("url", "[0-9]+$", 0).cast("int").alias("id"))


@query(f"SELECT id FROM {sql_values(RESPONSES, 'id, status, ct, declared, n')} WHERE status < 400 AND coalesce(TRY_CAST(declared AS BIGINT), 0) <= 1024 AND n BETWEEN 1 AND 1024")
def accepted_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asset_ops.accepted(responses(spark), Settings(max_bytes=1024)).select("id")


@query(r"SELECT DISTINCT 'http://' || regexp_extract(url, '^[^:]+://([^/?#]*)', 1) || '/p/' || page_id AS url FROM pages")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host has an index that names a sitemap of all its pages, itself, and a broken file."""
    pages = table(spark, sf_dir, "pages").select("page_id", urls.netloc(F.col("url")).alias("host"))
    root = F.concat(F.lit("http://"), F.col("host"))
    named = lambda tag, at: F.concat(F.lit(f"<{tag}><loc> "), at, F.lit(f" </loc></{tag}>"))
    ns = "xmlns='http://www.sitemaps.org/schemas/sitemap/0.9' xmlns:i='http://i'"
    picture = F.lit("<url><i:image><i:loc>http://no/pic</i:loc></i:image></url>")
    lists = pages.groupBy("host").agg(F.concat_ws("", F.collect_list(named("url", F.concat(root, F.lit("/p/"), F.col("page_id").cast("string"))))).alias("x"))
    maps = lists.select(F.concat(root, F.lit("/map.xml")).alias("url"), F.concat(F.lit(f"<urlset {ns}>"), "x", picture, F.lit("</urlset>")).alias("body"))
    hosts = pages.select("host").distinct()
    inner = F.concat(*[named("sitemap", F.concat(root, F.lit(f"/{n}.xml"))) for n in ("map", "index", "broken")])
    index = hosts.select(F.concat(root, F.lit("/index.xml")).alias("url"), F.concat(F.lit(f"<sitemapindex {ns}>"), inner, F.lit("</sitemapindex>")).alias("body"))
    broken = hosts.select(F.concat(root, F.lit("/broken.xml")).alias("url"), F.lit("<urlset><url>").alias("body"))
    bodies = maps.union(index).union(broken)
    robots = hosts.select("host", F.lit(200).alias("status"), F.concat(F.lit("User-agent: *\nsitemap: "), root, F.lit("/index.xml\n")).alias("body"))
    return policy.sitemap_pages(policy.sitemap_addresses(robots), lambda wanted: bodies.join(wanted.select("url"), "url", "left_semi"))


# --- throttle -----------------------------------------------------------------

RATE, CAPACITY = 0.001, 1.0


@query(f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), f AS (
  SELECT user_id, i, t, {CAPACITY} - 1.0 AS tokens, 0.0::DOUBLE AS wait FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i, e.t, CASE WHEN n >= 1 THEN n - 1 ELSE 0 END, CASE WHEN n >= 1 THEN 0 ELSE (1 - n) / {RATE!r} END
  FROM (SELECT e.*, least({CAPACITY}, f.tokens + (e.t - f.t) * {RATE!r}) AS n FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) e
)
SELECT user_id, count(*) AS n, CAST(sum(CAST(wait > 0 AS INT)) AS BIGINT) AS waited, round(sum(wait), 2) AS total FROM f GROUP BY 1""")
def token_bucket_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("request"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    waits = throttle.token_bucket_waits(log, RATE, CAPACITY)
    return waits.groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("n"), F.sum((F.col("wait") > 0).cast("long")).alias("waited"), F.round(F.sum("wait"), 2).alias("total"))


@query("""WITH RECURSIVE e AS (
  SELECT user_id, event_id::DOUBLE AS t, CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 200 ELSE 404 END AS status,
    CASE WHEN event_id % 10 = 0 THEN 7.0 END AS ra, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
), f AS (
  SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS c, 0.0::DOUBLE AS until FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i, k, greatest(f_until, coalesce(t + CASE WHEN pushed AND ra IS NULL THEN least(60.0, pow(2.0, least(k, 6))) WHEN pushed THEN least(60.0, ra) END, 0.0))
  FROM (SELECT e.*, f.until AS f_until, status IN (429, 503) AS pushed,
    CASE WHEN status IN (429, 503) AND ra IS NULL THEN f.c + 1 WHEN status IN (429, 503) THEN greatest(f.c - 1, 0) WHEN status = 200 THEN 0 ELSE f.c END AS k
    FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) e
)
SELECT user_id, CAST(max(c) AS BIGINT) AS most, max(until) AS last_block FROM f WHERE i > 0 GROUP BY 1""")
def host_block_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    status = F.when(n % 5 == 0, 429).when(n % 5 == 1, 503).when(n % 5 == 2, 200).otherwise(404)
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), n.cast("double").alias("t"), status.alias("status"), F.when(n % 10 == 0, 7.0).alias("retry_after"))
    return throttle.host_blocks(log).groupBy(F.col("host").alias("user_id")).agg(F.max("count").alias("most"), F.max("blocked_until").alias("last_block"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
