from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from webloom.functions import urls


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


NORMAL = [
    ("http://h/a#f", "http://h/a"),
    ("http://h/a?utm_source=x&b=1", "http://h/a?b=1"),
    ("http://h/a?REF=1", "http://h/a"),
    ("http://h/a?refresh=1&c", "http://h/a?c="),
    ("http://h/a?x=&x=1", "http://h/a?x=&x=1"),
    ("http://h/a?q=%20b~*", "http://h/a?q=+b~%2A"),
    ("http://h/a?q=%zz", "http://h/a?q=%25zz"),
    ("HTTP://H/a;p", "http://H/a;p"),
    ("http://h:80/é?n=é", "http://h:80/é?n=%C3%A9"),
    ("/rel?gclid=1#x", "/rel"),
]


@pytest.mark.parametrize("url,expected", NORMAL)
def test_normalize(spark, url, expected):
    assert one(spark, urls.normalize_url(F.col("u")), u=url) == expected
    assert one(spark, urls.normalize_url(F.col("u")), u=expected) == expected


def test_normalize_options(spark):
    assert one(spark, urls.normalize_url(F.col("u"), strip=False), u="http://h/?utm_a=1#x") == "http://h/?utm_a=1"
    assert one(spark, urls.normalize_url(F.col("u"), allow=["Ref"]), u="http://h/?ref=1&utm_a=2") == "http://h/?ref=1"


@pytest.mark.parametrize("ref", ["?y", "//h2/x", "../../../x", "x#f", "", "x y", "é"])
def test_join(spark, ref):
    base = "http://h/a/b?c"
    assert one(spark, urls.join_url(F.col("b"), F.col("r")), b=base, r=ref) == urljoin(base, ref)


PATHS = [("http://h/", "h/pages/index.html"), ("http://h", "h/pages/index.html"), ("http://h/a", "h/pages/a/index.html"), ("http://h/a/", "h/pages/a/index.html"), ("http://h/a.html", "h/pages/a.html"), ("http://h/a.PHP?x=1", "h/pages/a.PHP"), ("http://h/a.pdf", "h/pages/a.pdf/index.html"), ("http://h/../a.html", "h/pages/_/a.html")]


@pytest.mark.parametrize("url,expected", PATHS)
def test_page_path(spark, url, expected):
    assert one(spark, urls.page_path(F.col("u"), F.lit("http://h/")), u=url) == expected


def test_names_and_origins(spark):
    assert one(spark, urls.sanitize_filename(F.col("n")), n='a<b>:"c') == "a_b___c"
    assert one(spark, urls.sanitize_filename(F.col("n")), n="") == "file"
    assert one(spark, urls.sanitize_filename(F.col("n")), n=".x" + "y" * 300) == "_x" + "y" * 198
    assert one(spark, urls.same_origin(F.col("a"), F.col("b")), a="http://h/x", b="https://h/x") is False
    assert one(spark, urls.same_origin(F.col("a"), F.col("b")), a="http://h/x", b="http://h:80/x") is False
    assert one(spark, urls.can_fetch(F.col("u")), u=None) is False


@pytest.mark.parametrize("target,folder,expected", [("h/a/x.css", "h/p", "../a/x.css"), ("h/p/x", "h/p", "x"), ("x", "", "x"), ("a/b", "a/b/c/d", "../..")])
def test_relative(spark, target, folder, expected):
    assert one(spark, urls.relative_path(F.col("t"), F.col("f")), t=target, f=folder) == expected


def test_endings(spark):
    for name, expected in {"a.b.c": ".c", ".hidden": "", "a": "", "a/b.d/c": "", "..x.y": ".y"}.items():
        assert one(spark, urls.ending(F.col("n")), n=name) == expected
