from webloom.functions import texts
from webloom.operators import html, rewrite

PAGE = """<html><head><base href="/b/"><link rel=stylesheet href='s.css' integrity="x"><link rel="preload" as="script" href="no.js">
<link rel="preload" as="font" href="f.woff2"><style>@import "i.css"; a{background:url('z.png')}</style></head>
<body style="background:url(bg.png)"><!-- <a href="/comment"> --><a href=/plain>x</a><a href="/a?x=1&amp;y=2#f">y</a>
<a href="mailto:x@y">m</a><img src=i.png srcset="i1.png 1x, i2.png 2x"><video src=v.mp4 poster=p.jpg></video>
<input type=image src=in.png><script src="k.js"></script><script>var t = "<a href='/script'>"; </script></body></html>"""


def test_references():
    found = [(k, u) for k, _, _, u in html.references(PAGE, "http://h/x/page")]
    assert [u for k, u in found if k == "anchor"] == ["http://h/plain", "http://h/a?x=1&y=2#f"]
    assert {u for k, u in found if k == "link"} == {"http://h/b/s.css", "http://h/b/f.woff2"}
    assert {u for k, u in found if k == "src"} == {"http://h/b/i.png", "http://h/b/v.mp4", "http://h/b/in.png"}
    assert {u for k, u in found if k == "srcset"} == {"http://h/b/i1.png", "http://h/b/i2.png"}
    assert {u for k, u in found if k == "style"} == {"http://h/b/z.png", "http://h/b/i.css"}
    assert {u for k, u in found if k in ("poster", "style_attr", "script")} == {"http://h/b/p.jpg", "http://h/b/bg.png", "http://h/b/k.js"}
    assert not [1 for k, *_ in html.references(PAGE, "http://h/", skip_js=True) if k == "script"]


def test_rewrite():
    assets = {f"http://h/b/{n}": f"../as/{n}" for n in ("s.css", "i.png", "i2.png", "z.png", "i.css")}
    pages = {"http://h/a?x=1&y=2": "../a/index.html"}
    out = html.rewrite(PAGE, "http://h/x/page", assets.get, pages.get)
    assert "<base" not in out and "integrity" not in out
    assert 'href="../as/s.css"' in out and "i1.png 1x, ../as/i2.png 2x" in out
    assert "@import url(\"../as/i.css\");" in out and "url('../as/z.png')" in out
    assert 'href="../a/index.html#f"' in out and "<a href=/plain>" in out
    same = "<p>unclosed <b>x &nbsp; <A HREF='/q'>"
    assert html.rewrite(same, "http://h/", {}.get, {}.get) == same


def test_texts():
    assert texts.srcset_urls("a 1x, b 2x,, a") == ["a", "b", "a"]
    assert texts.css_urls("url(data:x) url( 'a' ) url(a)") == ["a"]
    assert texts.rewrite_css("url(a) url(b)", {"a": "c"}.get) == "url(c) url(b)"
    assert texts.rewrite_script("f('/a.js') + \"x\"", {"/a.js": "b.js"}.get) == "f('b.js') + \"x\""
    assert texts.rewrite_script("fetch('/a'); g('/a')", {"/a": "b"}.get, loads_only=True) == "fetch('b'); g('/a')"


def test_css_and_script_forms():
    text = "@IMPORT url( 'a.css' ) ; @import 'b.css' screen; x{background:URL( \"c.png\" ) url() url('d) url(e.png)}"
    assert texts.css_urls(text) == ["a.css", "c.png", "e.png"]
    assert texts.rewrite_css(text, {"a.css": "1", "c.png": "2"}.get) == "@import url('1'); @import 'b.css' screen; x{background:url(\"2\") url() url('d) url(e.png)}"
    script = "a = 'it'; b=\"//h/x y\"; c='/p q'; d='img/l.png'; e='x.js'; f=':a.js'; g='.js'; h=\"don't /x.js\"; i='https://h/'"
    assert texts.script_urls(script) == ["//h/x y", "img/l.png", "https://h/"]
    assert texts.rewrite_script("['a/b.js','c']", {"a/b.js": "z"}.get) == "['z','c']"


def test_rewrite_pages(spark):
    pages = spark.createDataFrame([(1, "http://h/x/", "<a href='/y#f'>y</a><img src=/i.png>"), (2, "http://h/y", None)], "page_id long, url string, html string")
    assets = spark.createDataFrame([("http://h/i.png", "h/assets/img/i.png")], "url string, local_path string")
    known = spark.createDataFrame([("http://h/y", "h/pages/y/index.html")], "url string, local_path string")
    rows = {r.page_id: r for r in rewrite.rewrite_pages(pages, assets, known, "http://h/").collect()}
    assert rows[1].html == '<a href="../y/index.html#f">y</a><img src="../../assets/img/i.png">' and rows[1].changed
    assert rows[2].html == "" and not rows[2].changed


def test_rewrite_files(spark):
    files = spark.createDataFrame([("http://h/s/a.css", "h/assets/css/a.css", "x{background:url(../i.png)}")], "url string, local_path string, text string")
    assets = spark.createDataFrame([("http://h/i.png", "h/assets/img/i.png")], "url string, local_path string")
    row = rewrite.rewrite_texts(files, assets, "css").first()
    assert row.text_out == "x{background:url(../img/i.png)}" and row.changed
