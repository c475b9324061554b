"""Queries over pages that the smallest tables do not have, against their SQL."""

import tracemalloc

import duckdb
import pyarrow as pa
import pytest

from webloom.operators import batches, html, policy
from webloom.plans import registry

PAGES = [
    (1, "http://h.org/a?x=1", "<p>ü"), (2, "http://h.org/a?x=1", "<p>"), (3, "http://h.org", ""), (4, "/no/host", "<a>"),
    (5, "", "x"), (6, None, "xy"), (7, "http://k.org/b", None),
]


def both(spark, tmp_path, name, rows):
    """The query's rows and its SQL's, by (sorted) column names."""
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = registry.queries()[name](spark, str(tmp_path)), con.sql(registry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    return sorted(map(tuple, got.select(names).collect()), key=str), sorted(want.project(", ".join(names)).fetchall(), key=str)


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_warc_rows_of_pages(spark, tmp_path, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got, want = both(spark, tmp_path, "warc_rows_of_pages", PAGES)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and len(got) == 2 * len(PAGES)


class Caught:
    """A stand-in for a table that runs the worker's function here, over one batch."""

    sparkSession = None

    def __init__(self, columns):
        self.batch = pa.RecordBatch.from_pydict(columns)

    def select(self, *columns):
        return self

    where = select

    def mapInArrow(self, run, schema):
        return lambda: (b.num_rows for b in run(iter([self.batch])))

    def mapInPandas(self, run, schema):
        return lambda: (len(b) for b in run(iter([self.batch.to_pandas()])))


def peak_mb(run):
    """Rows made, and the most MB of Python objects that making them took."""
    tracemalloc.start()
    try:
        return sum(run()), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_workers_hold_a_few_rows(spark, monkeypatch):
    for module in (batches, html, policy):
        monkeypatch.setattr(module, "ship", lambda spark: None, raising=False)
    n = 1500
    page = "".join(f"<a href='/{i}'>" for i in range(40))
    pages = Caught({"page_id": list(range(n)), "url": [f"http://h/{i}" for i in range(n)], "html": [page] * n})
    rows, mb = peak_mb(html.page_references(pages))
    assert rows == 40 * n and mb < 4
    files = Caught({"host": [f"h{i}" for i in range(n)], "body": ["User-agent: *\n" + "".join(f"Disallow: /{i}\n" for i in range(40))] * n})
    rows, mb = peak_mb(policy.robots_rules(files))
    assert rows == 40 * n and mb < 4


def test_page_references_of_odd_rows(spark):
    link = "<a href='/x'>"
    rows = [(2**60 + 1, "http://h/a", link * 2500), (None, "http://h/b", link), (3, None, link), (4, "http://h/c", None)]
    got = html.page_references(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert [r.page_id for r in got] == [2**60 + 1] * 2500 + [None, 3]
    assert {(r.page_url, r.kind, r.ref, r.url) for r in got} == {("http://h/a", "anchor", "/x", "http://h/x"), ("http://h/b", "anchor", "/x", "http://h/x"), (None, "anchor", "/x", "/x")}
    assert [r.place for r in got][:2500] == [13 * i for i in range(2500)]
