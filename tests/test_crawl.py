from webloom.config import Settings
from webloom.operators import crawl, export, state
from webloom.plans import site
from webloom.sources import snapshot

SITE = {"/": ["/a", "/b", "http://other/x"], "/a": ["/c", "/"], "/b": ["/c?utm_x=1", "/b#self"], "/c": ["/d"], "/d": ["/e"]}


def pages_of(spark):
    rows = [(i, f"http://h{p}", "".join(f"<a href='{x}'>" for x in out)) for i, (p, out) in enumerate(SITE.items())]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def walk(spark, **more):
    return crawl.crawl(spark, ["http://h/"], snapshot.from_pages(pages_of(spark)), Settings(crawl=True, **more))


def test_depths_and_budget(spark):
    rows = {r.url: r for r in walk(spark, max_depth=9).collect()}
    assert {u: r.depth for u, r in rows.items() if r.status == "page"} == {"http://h/": 0, "http://h/a": 1, "http://h/b": 1, "http://h/c": 2, "http://h/d": 3}
    assert rows["http://h/e"].status == "other" and "http://other/x" not in rows
    assert [r.url for r in walk(spark, max_depth=9, max_pages=2).where("status = 'page'").orderBy("seq").collect()] == ["http://h/", "http://h/a"]
    assert walk(spark, max_depth=0).count() == 1


def test_resume(spark, tmp_path):
    at = f"file://{tmp_path}/state"
    fetch = snapshot.from_pages(pages_of(spark))
    crawl.crawl(spark, ["http://h/"], fetch, Settings(crawl=True, max_depth=1), on_round=lambda v, f, d: state.save_checkpoint(spark, at, v, f.limit(0) if d > 1 else f, d))
    visited, frontier, depth = state.load_checkpoint(spark, at)
    assert depth == 2 and visited.where("status = 'page'").count() == 3
    assert state.load_checkpoint(spark, f"{at}-none") is None


def test_mirror(spark, tmp_path):
    bodies = spark.createDataFrame(
        [("http://h/s.css", 200, "text/css", None, b"a{background:url(i.png)}"), ("http://h/i.png", 200, "image/png", "3", b"png"), ("http://h/big", 200, "text/css", "999999999", b"x")],
        "url string, status int, content_type string, content_length string, body binary",
    )
    pages = spark.createDataFrame([(0, "http://h/", "<link rel=stylesheet href=/s.css><link rel=stylesheet href=/big><a href=/a>"), (1, "http://h/a", "<a href='/'>")], "page_id long, url string, html string")
    out = site.mirror_site(spark, "http://h/", snapshot.from_pages(pages), snapshot.from_bodies(bodies), f"file://{tmp_path}", Settings(crawl=True))
    files = {r.local_path: bytes(r.body).decode() for r in out.collect()}
    css = next(k for k in files if k.startswith("h/assets/css/"))
    image = next(k for k in files if k.startswith("h/assets/img/"))
    assert files["h/pages/index.html"].count("../assets/css/") == 1 and 'href="a/index.html"' in files["h/pages/index.html"]
    assert f"url(../img/{image.rsplit('/', 1)[1]})" in files[css] and len(files) == 4
    found = state.read_json(spark, f"file://{tmp_path}/h-manifest.json")
    assert found["pages"] == ["h/pages/index.html", "h/pages/a/index.html"] and len(found["assets"]) == 2
    assert {k: (tmp_path / k).read_text() for k in files} == files


def test_export(spark, tmp_path):
    rows = [("h/a.html", "http://h/b", b"2"), ("h/a.html", "http://h/a", b"1"), ("../up", "u", b"x"), ("h/none", "n", None), (None, "p", b"y"), ("h/long", "l", b"z" * 3_000_000)]
    files = spark.createDataFrame(rows, "local_path string, url string, body binary")
    for _ in range(2):  # files of an earlier run are replaced
        done = {r.local_path: r.bytes for r in export.export_files(files, str(tmp_path / "out")).collect()}
    assert done == {"h/a.html": 1, "../up": 1, "h/none": 0, "h/long": 3_000_000}
    kept = {str(p.relative_to(tmp_path)): p.read_bytes()[:1] for p in tmp_path.rglob("*") if p.is_file() and p.suffix != ".crc"}
    assert kept == {"out/h/a.html": b"1", "out/_/up": b"x", "out/h/none": b"", "out/h/long": b"z"}
    assert export.export_files(files.limit(0), str(tmp_path / "empty")).count() == 0
