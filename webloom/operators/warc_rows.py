"""Request and response records of fetched pages, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls

HEADERS = "array<struct<k:string,v:string>>"


def with_host(headers, url):
    """Headers with Host in front, unless there is one."""
    has = F.exists(headers, lambda h: F.lower(h["k"]) == "host")
    return F.when(has | (F.coalesce(urls.netloc(url), F.lit("")) == ""), headers).otherwise(F.concat(F.array(F.struct(F.lit("Host").alias("k"), urls.netloc(url).alias("v"))), headers))


def request_response_rows(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, *keep, record_type, http_line, headers, payload, ord), the request before its response.

    ``responses`` has url, method, status, reason, request_headers, headers,
    request_body, body; columns of it in ``keep`` go along, as URLs may repeat.
    Without a URL there is no request line.
    """
    at = F.when(urls.path(F.col("url")) == "", "/").otherwise(urls.path(F.col("url")))
    at = F.concat(at, F.when(urls.query(F.col("url")) != "", F.concat(F.lit("?"), urls.query(F.col("url")))).otherwise(""))
    none = F.lit(b"").cast("binary")
    request = F.struct(
        F.lit("request").alias("record_type"),
        F.concat(F.coalesce("method", F.lit("GET")), F.lit(" "), at, F.lit(" HTTP/1.1")).alias("http_line"),
        with_host(F.coalesce("request_headers", F.array().cast(HEADERS)), F.col("url")).alias("headers"),
        F.coalesce("request_body", none).alias("payload"),
        F.lit(0).alias("ord"),
    )
    response = F.struct(
        F.lit("response").alias("record_type"),
        F.trim(F.concat_ws(" ", F.lit("HTTP/1.1"), F.col("status").cast("string"), F.col("reason"))).alias("http_line"),
        F.coalesce("headers", F.array().cast(HEADERS)).alias("headers"),
        F.coalesce("body", none).alias("payload"),
        F.lit(1).alias("ord"),
    )
    return responses.select("url", *keep, F.explode(F.array(request, response)).alias("r")).select("url", *keep, "r.*")
