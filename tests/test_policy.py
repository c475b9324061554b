from webloom.operators import policy, state, throttle, warc_rows
from webloom.streaming.throttle import token_bucket_stream

ROBOTS = "User-agent: Bot\nDisallow: /x\n\nUser-agent: *\nDisallow: /p\nAllow: /p/open\nCrawl-delay: 3\nSitemap: http://h/s.xml\n"


def test_robots(spark):
    files = spark.createDataFrame([("h", 200, ROBOTS), ("gone", 404, "User-agent: *\nDisallow: /")], "host string, status int, body string")
    rules = policy.robots_rules(files)
    wanted = spark.createDataFrame([(f"http://{u}",) for u in ("h/x", "h/p/open", "h/q", "gone/x")], "url string")
    may = lambda agent: {r.url for r in policy.may_fetch(wanted, rules, agent).collect()}
    assert may("bot/2") == {"http://h/p/open", "http://h/q", "http://gone/x"}
    assert may("else") == {"http://h/x", "http://h/q", "http://gone/x"}  # the first rule that fits decides
    assert policy.crawl_delay(rules, "else").first().crawl_delay == 3.0
    assert policy.sitemap_addresses(files).first().url == "http://h/s.xml"


def test_robots_escapes_and_groups(spark):
    body = "User-agent: web\nDisallow: /a%20b\nDisallow: /c+d\n\nUser-agent: webloom\nDisallow: /\n\nUser-agent: *\nDisallow: /\n"
    rules = policy.robots_rules(spark.createDataFrame([("h", 200, body)], "host string, status int, body string"))
    wanted = spark.createDataFrame([(f"http://h/{p}",) for p in ("a%20b/c", "a b", "ab", "c+d", "c%2Bd", "c d", "100%")], "url string")
    assert {r.url for r in policy.may_fetch(wanted, rules, "webloom/1").collect()} == {"http://h/ab", "http://h/c d", "http://h/100%"}


def test_pauses_block_a_host(monkeypatch):
    from webloom.config import Settings
    from webloom.sources import http

    now = [100.0]
    monkeypatch.setattr(http.time, "monotonic", lambda: now[0])
    host = http.Host(Settings(max_backoff=10.0))
    host.told(429, None)
    assert host.until == 102.0
    host.told(503, "7")
    assert (host.until, host.pushes) == (107.0, 0)
    host.told(503, "99")
    assert host.until == 110.0
    host.told(200, None)
    assert host.pushes == 0 and host.wait() == 10.0
    assert http.seconds_of("junk") is None and http.seconds_of("Thu, 01 Jan 1970 00:02:00 GMT") == 0.0


def test_json_is_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    for n in (1, 2):
        state.write_json(spark, path, {"n": n})
        assert state.read_json(spark, path) == {"n": n}


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="http://i"'
    index = f"<sitemapindex {ns}><sitemap><loc>http://h/b.xml</loc></sitemap><sitemap><loc>http://h/a.xml</loc></sitemap></sitemapindex>"
    urls = f"<urlset {ns}><url><loc> http://h/1 </loc><i:image><i:loc>http://h/pic</i:loc></i:image></url></urlset>"
    bodies = spark.createDataFrame([("http://h/a.xml", index), ("http://h/b.xml", urls), ("http://h/c.xml", "<broken")], "url string, body string")
    start = spark.createDataFrame([("http://h/a.xml",), ("http://h/c.xml",)], "url string")
    found = policy.sitemap_pages(start, lambda w: bodies.join(w, "url"))
    assert [r.url for r in found.collect()] == ["http://h/1"]


def test_cookies(spark):
    cookies = spark.createDataFrame([(".h.com", "/", False, "a", "1"), ("h.com", "/p", True, "b", "2"), (".com", "/", False, "c", "3"), (".h.com", "/p", False, "a", "9")], "domain string, path string, secure boolean, name string, value string")
    wanted = spark.createDataFrame([("https://h.com/p/x",), ("http://w.h.com/",)], "url string")
    got = {(r.url, r.name, r.value) for r in policy.cookies_for(wanted, cookies).collect()}
    assert got == {("https://h.com/p/x", "a", "9"), ("https://h.com/p/x", "b", "2"), ("https://h.com/p/x", "c", "3"), ("http://w.h.com/", "a", "1"), ("http://w.h.com/", "c", "3")}


def bucket(times, rate, capacity):
    tokens, at, out = capacity, times[0], []
    for t in times:
        tokens, at = min(capacity, tokens + (t - at) * rate), t
        out.append(0.0 if tokens >= 1 else (1 - tokens) / rate)
        tokens = tokens - 1 if tokens >= 1 else 0.0
    return out


def test_token_bucket(spark, tmp_path):
    times = [0.0, 0.0, 0.1, 0.2, 5.0, 5.0, 5.1, 9.0]
    log = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)], "key string, request long, t double")
    got = [r.wait for r in throttle.token_bucket_waits(log, 1.0, 2.0).orderBy("request").collect()]
    assert got == bucket(times, 1.0, 2.0)
    log.where("t < 5").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = token_bucket_stream(spark.readStream.schema(log.schema).parquet(f"file://{tmp_path}/in"), 1.0, 2.0)
    query = stream.writeStream.format("memory").queryName("waits").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.wait for r in spark.sql("select wait from waits order by request").collect()] == bucket(times[:4], 1.0, 2.0)


def test_blocks(spark):
    log = spark.createDataFrame([("h", 0.0, 429, None), ("h", 1.0, 503, None), ("h", 2.0, 429, 1.0), ("h", 3.0, 200, None), ("h", 4.0, 429, None)], "host string, t double, status int, retry_after double")
    assert [(r["count"], r.blocked_until) for r in throttle.host_blocks(log).orderBy("t").collect()] == [(1, 2.0), (2, 5.0), (1, 5.0), (0, 5.0), (1, 6.0)]


def test_warc_rows_and_state(spark):
    kinds = "url string, method string, status int, reason string, request_headers array<struct<k:string,v:string>>, headers array<struct<k:string,v:string>>, request_body binary, body binary"
    rows = warc_rows.request_response_rows(spark.createDataFrame([("http://h/p?q", None, 404, None, [("A", "1")], [], None, b"x")], kinds)).orderBy("ord").collect()
    assert [r.http_line for r in rows] == ["GET /p?q HTTP/1.1", "HTTP/1.1 404"] and rows[0].headers[0].v == "h" and bytes(rows[1].payload) == b"x"
    store = spark.createDataFrame([("a", "1"), ("b", "2")], "url string, local_path string")
    assert {tuple(r) for r in state.upsert(store, spark.createDataFrame([("b", "3")], "url string, local_path string")).collect()} == {("a", "1"), ("b", "3")}
