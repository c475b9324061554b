"""Crawls that end where their budget does, not before."""

from webloom.config import Settings
from webloom.plans import registry, site
from webloom.sources import snapshot


def test_dead_sitemap_addresses_use_no_budget(spark, tmp_path):
    pages = spark.createDataFrame([(0, "http://h/", "<p>"), (1, "http://h/z1", "<p>"), (2, "http://h/z2", "<p>")], "page_id long, url string, html string")
    dead = [f"http://h/a{i}" for i in range(5)]
    xml = "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in [*dead, "http://h/z1", "http://h/z2"]) + "</urlset>"
    maps = spark.createDataFrame([("http://h/s.xml", xml)], "url string, body string")
    robots = spark.createDataFrame([("h", 200, "Sitemap: http://h/s.xml")], "host string, status int, body string")
    none = spark.createDataFrame([], "url string, status int, content_type string, content_length string, body binary")
    s = Settings(crawl=True, max_pages=3, sitemap_seed=True)
    out = site.mirror_site(spark, "http://h/", snapshot.from_pages(pages), snapshot.from_bodies(none), f"file://{tmp_path}", s, robots, lambda wanted: maps.join(wanted, "url"))
    assert {r.url for r in out.collect()} == {"http://h/", "http://h/z1", "http://h/z2"}


def test_crawl_bfs_has_no_default_budget(spark, tmp_path):
    links = "".join(f'<a href="/p{i}">x</a>' for i in range(130))
    rows = [(0, "http://h/", links)] + [(i + 1, f"http://h/p{i}", "<p>") for i in range(130)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = registry.queries()["crawl_bfs"](spark, str(tmp_path))
    assert out.where("status = 'page'").count() == 131
