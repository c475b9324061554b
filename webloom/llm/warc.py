"""A deterministic sharded WARC writer and its reader.

Records are ordered by page id, those of one id by a hash of the payload, and cut
into shards at fixed sums of payload bytes, so the same table always gives the same files.  A task writes a shard's
records one after another, each a gzip member of its own, and starts a new file
once the compressed size is reached.  Headers, record ids and digests are made
anew.  Files are written under temporary names and renamed when complete; a
manifest for each shard, written last, names them.  A task that runs again
replaces its files by equal ones.

Of equal payloads the record with the largest page id is the response; the
others are revisits of it without a payload.

Cases: null html is an empty payload; page ids may lie as far apart as they
like; rows without a page id come first, have no
id in the answer, and never are the largest unless no row of the payload has
one; of rows with equal id and payload one is the response and the rest revisit
it; a null url becomes ``urn:page:ID``; an empty table gives an archive without
files and an empty answer.  Rows keep their number: one record each.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from io import BufferedReader

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, lean, materialize, tune

# Fixed values of the WARC format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = b"WebLoom-Page-ID"
REFERS_HEADER = b"WebLoom-Refers-To-Page-ID"

#: Ranges that byte sums are added up in, and tasks that write or read, at most.
MOST_RANGES = 4096
MOST_TASKS = 20_000


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    #: Payload bytes of a shard: a 4096th of all, within these bounds.
    shard_bytes_low: int = 4 << 20
    shard_bytes_high: int = 1 << 30
    #: Compressed bytes after which a new file begins.
    roll_bytes: int = 256 << 20
    date: str = "1970-01-01T00:00:00Z"
    level: int = 6


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, again: int) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{again}')}>".encode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None, again: int, date: str) -> bytes:
    """The bytes of one record; ``refers_to`` is (page id,) for a revisit."""
    digest = sha1_base32(payload)
    uri = url if url is not None else f"urn:page:{page_id}"
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    headers = [
        (b"WARC-Type", b"revisit" if refers_to else b"response"),
        (b"WARC-Record-ID", record_id(page_id, digest, again)),
        (b"WARC-Date", date.encode()),
        (b"WARC-Target-URI", uri.encode()),
        (b"Content-Type", b"application/http; msgtype=response"),
        (b"WARC-Payload-Digest", b"sha1:" + digest.encode()),
        (b"WARC-Block-Digest", b"sha1:" + sha1_base32(block).encode()),
    ]
    if page_id is not None:
        headers.append((PAGE_HEADER, b"%d" % page_id))
    if refers_to:
        headers += [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", record_id(refers_to[0], digest, 0))]
        if refers_to[0] is not None:
            headers.append((REFERS_HEADER, b"%d" % refers_to[0]))
    headers.append((b"Content-Length", b"%d" % len(block)))
    return VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in headers) + b"\r\n" + block + b"\r\n\r\n"


class ShardWriter:
    """The files of one shard, rolled by compressed size, then its manifest."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, s: Settings):
        self.fs, self.folder, self.shard, self.s = fs, folder, shard, s
        self.files: list[dict] = []
        self.out = None

    def _place(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _open(self) -> None:
        self.name = f"part-{self.shard:07d}-{len(self.files):04d}.warc.gz"
        self.temporary = self._place(f".{self.name}.{uuid.uuid4().hex}.tmp")
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size, self.records, self.sha = 0, 0, hashlib.sha1()
        body = f"software: webloom\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        head = [
            (b"WARC-Type", b"warcinfo"),
            (b"WARC-Record-ID", record_id(None, self.name, 0)),
            (b"WARC-Date", self.s.date.encode()),
            (b"Content-Type", b"application/warc-fields"),
            (b"Content-Length", b"%d" % len(body)),
        ]
        self._member(VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in head) + b"\r\n" + body + b"\r\n\r\n")

    def _member(self, data: bytes) -> None:
        member = gzip.compress(data, self.s.level, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def _finish(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self._place(self.name))
        self.files.append({"file": self.name, "bytes": self.size, "records": self.records, "sha1": self.sha.hexdigest()})
        self.out = None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self._open()
        self._member(record)
        self.records += 1
        if self.size >= self.s.roll_bytes:
            self._finish()

    def commit(self) -> list[dict]:
        if self.out is not None:
            self._finish()
        write_whole(self.fs, self._place(f"manifest-{self.shard:07d}.json"), json.dumps({"shard": self.shard, "files": self.files}).encode())
        return self.files


def write_whole(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write under a temporary name, then rename."""
    folder, _, name = path.rpartition("/")
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    fs.move(temporary, path)


def sort_keys(ids: np.ndarray, has_id: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Byte strings in the order of (page id with null first, spread)."""
    out = np.ones((len(ids), 18), np.uint8)  # the last byte keeps zeros at the end apart
    out[:, 0] = has_id
    flip = np.uint64(1 << 63)
    out[:, 1:9] = (np.where(has_id, ids, 0).astype(np.int64).view(np.uint64) ^ flip).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:17] = (spread.astype(np.int64).view(np.uint64) ^ flip).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S18").ravel()


def shard_column(rows: DataFrame, s: Settings) -> tuple[Column, int]:
    """The shard of a row (page_id, spread), and how many there are.

    Rows stand in the order of page id (null first) and ``spread``, a hash of
    the payload; a shard begins where the payload bytes before it pass a
    multiple of the shard size.  The sums before each key come from a sort by
    range: sums of its partitions, and sums within each.  So the distance
    between ids plays no part, and rows without an id fill as many shards as
    their bytes ask for.  Only the first key of each shard comes to the driver.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    shard_bytes = min(max(s.shard_bytes_low, total // 4096), s.shard_bytes_high)
    order = [F.col("page_id").asc_nulls_first(), F.col("spread").asc()]
    sums = rows.groupBy("page_id", "spread").agg(F.sum("n_bytes").alias("bytes"))
    sums = sums.repartitionByRange(max(1, min(-(-total // shard_bytes), MOST_RANGES)), *order).sortWithinPartitions(*order)
    sums = materialize(sums.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "warc-order")
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("bytes").alias("all"))
    parts = parts.select("part", F.coalesce(F.sum("all").over(up_to(Window.orderBy("part"))), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("bytes").over(up_to(Window.partitionBy("part").orderBy("at"))), F.lit(0))
    placed = sums.withColumn("own", own).join(F.broadcast(parts), "part")  # MOST_RANGES rows at most
    shard = F.floor((F.col("own") + F.col("before")) / shard_bytes)
    firsts = placed.groupBy(shard.alias("shard")).agg(F.min_by(F.struct("page_id", "spread"), "at").alias("key")).orderBy("shard").select("key.*").collect()[1:]
    has = np.array([r.page_id is not None for r in firsts], bool)
    edges = spark.sparkContext.broadcast(sort_keys(np.array([r.page_id or 0 for r in firsts], np.int64), has, np.array([r.spread for r in firsts], np.int64)))

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, has_id: pd.Series, spread: pd.Series) -> pd.Series:
        keys = sort_keys(ids.to_numpy(np.int64), has_id.to_numpy(bool), spread.to_numpy(np.int64))
        return pd.Series(np.searchsorted(edges.value, keys, side="right").astype(np.int32))

    return shard_of(F.coalesce("page_id", F.lit(0).cast("long")), F.col("page_id").isNotNull(), "spread"), len(firsts) + 1


def write_archive(pages: DataFrame, folder: str, s: Settings = Settings()) -> DataFrame:
    """Write all pages under ``folder`` (a URI); one row per file: shard, file, bytes, records, sha1.

    ``pages`` has page_id, url, html.
    """
    spark = pages.sparkSession
    tune(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.length("payload").cast("long"))
    rows = rows.withColumn("spread", F.xxhash64("digest"))
    narrow = rows.select("page_id", "digest", "spread", "n_bytes")
    shard, shards = shard_column(narrow, s)
    repeated = narrow.groupBy("digest", "n_bytes").agg(F.count("*").alias("times"), F.max("page_id").alias("newest")).where("times > 1").drop("times")
    notes = narrow.join(repeated.hint("merge"), ["digest", "n_bytes"]).select("page_id", "digest", "spread", "newest").distinct()
    # Notes on repeated payloads travel beside the pages and come before them, so that payloads are shuffled once.
    notes = notes.select(shard.alias("shard"), "page_id", "digest", F.lit(0).alias("order"), "newest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    whole = rows.select(shard.alias("shard"), "page_id", "digest", F.lit(1).alias("order"), F.lit(None).cast("long").alias("newest"), "url", "payload")
    tasks = min(shards, MOST_TASKS)
    rows = notes.union(whole).repartitionById(tasks, F.pmod("shard", F.lit(tasks)))
    rows = rows.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "order", F.col("url").asc_nulls_first())
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        done: list[tuple] = []
        writer, last, again = None, None, 0
        note, newest = None, None
        for batch in batches:
            for shard, page_id, digest, order, latest, url, data in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None or writer.shard != shard:
                    done += [(writer.shard, f) for f in writer.commit()] if writer else []
                    writer, last, note = ShardWriter(fs, root, shard, s), None, None
                if not order:
                    note, newest = (page_id, digest), latest
                    continue
                again = again + 1 if last == (page_id, digest) else 0
                last = (page_id, digest)
                alone = note != last or newest == page_id  # newest: None only where no row of the payload has an id
                refers_to = None if alone and not again else (newest if note == last else page_id,)
                writer.add(build_record(page_id, url, data, refers_to, again, s.date))
        done += [(writer.shard, f) for f in writer.commit()] if writer else []
        columns = [[x[0] for x in done], *([x[1][k] for x in done] for k in ("file", "bytes", "records", "sha1"))]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "file", "bytes", "records", "sha1"])

    written = rows.mapInArrow(lean(run), "shard long, file string, bytes long, records long, sha1 string")
    files = materialize(written, "warc-files")
    sums = files.agg(F.count("*"), F.sum("bytes"), F.sum("records")).first()
    write_whole(fs, f"{root}/manifest.json", json.dumps({"files": sums[0], "bytes": sums[1] or 0, "records": sums[2] or 0}).encode())
    return files


def read_archive(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    The digest of a response is made from its payload again and has to equal its
    header's; a revisit has its length and digest from its headers.
    """
    tune(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    for record in iterate_records(raw):
                        if record is not None:
                            rows.append(record)
                            held += len(record[6] or b"")
                        if held > (8 << 20) or len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    # A task for each shard: names are small, and would otherwise be put together in one.
    tasks = max(1, min((files.agg(F.max("shard")).first()[0] or 0) + 1, MOST_TASKS))
    named = files.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))
    return named.sortWithinPartitions("file").select("file").mapInArrow(lean(run), schema)


def iterate_records(raw) -> Iterator[tuple | None]:
    """Parsed responses and revisits of a gzip-member WARC stream; None for other records."""
    stream = BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16)
    while line := stream.readline():
        if not line.strip():
            continue
        if line.strip() != VERSION:
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.partition(b":")
            headers[key.lower()] = value.strip()
        block = stream.read(int(headers[b"content-length"]))
        kind = headers[b"warc-type"].decode()
        if kind not in ("response", "revisit"):
            yield None
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = headers[b"warc-payload-digest"].decode().removeprefix("sha1:")
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if kind == "response" and (sha1_base32(payload) != digest or len(payload) != length):
            raise ValueError(f"damaged record {headers[b'warc-record-id']!r}")
        number = lambda key: int(headers[key.lower()]) if key.lower() in headers else None
        yield number(PAGE_HEADER), length, digest, kind, number(REFERS_HEADER), headers[b"warc-target-uri"].decode(), payload if kind == "response" else None


def archive_and_read(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Write all pages to a fresh folder beside the checkpoints and read them back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    if "://" not in folder:
        folder = f"file://{folder.removeprefix('file:')}"
    files = write_archive(pages, folder, s)
    return read_archive(spark, folder, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
