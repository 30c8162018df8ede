"""A deterministic sharded writer of WARC archives, and their reader.

Shards are ranges of page_id with about equal bytes: exact byte counts per fixed-width bucket of
ids give the boundaries, and a bucket that alone is over the target is dealt on by a hash of
its content. Each shard is written by one task in the order of (page_id, digest, url), one gzip
member per record; a file is closed once its compressed size reaches the roll size. Headers,
record ids and digests are derived from the page alone, so a task that runs again, wherever
that is, writes the same bytes. Files are written under temporary names and renamed; the
manifest (one row per file: name, records, bytes, SHA-256) is written last by Spark's own
commit, and readers read what the manifest lists.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.llm.common import fresh_path, slices, table

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"

#: Range of ids is cut into so many buckets for the byte counts.
BUCKETS = 2048
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 9562


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit (refers_to is set) holds the HTTP header only."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]) + CRLF * 2
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)),
            ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + CRLF + block + CRLF * 2


def parsed(raw: bytes) -> dict:
    """The fields of one record; fails if a length or digest in it is wrong."""
    head, _, rest = raw.partition(CRLF * 2)
    version, *lines = head.split(CRLF)
    if version != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.decode(): v.decode() for k, _, v in (x.partition(b": ") for x in lines)}
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block):] != CRLF * 2 or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError("a record's block is damaged")
    http, _, payload = block.partition(CRLF * 2)
    size = next(int(x.partition(b": ")[2]) for x in http.split(CRLF) if x.lower().startswith(b"content-length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a record's payload is damaged")
    page, first = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return {"page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": size,
            "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(first) if first else None}


class _File:
    """An archive that is being written under a temporary name."""

    def __init__(self, folder: str, name: str) -> None:
        self.at, self.path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.name, self.temp = name, f"_temporary-{uuid.uuid4().hex}-{name}"
        self.at.create_dir(self.path, recursive=True)
        self.out = self.at.open_output_stream(f"{self.path}/{self.temp}", compression=None)
        self.records = self.bytes = 0
        self.sha = hashlib.sha256()

    def add(self, raw: bytes) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = pack.compress(raw) + pack.flush()
        self.out.write(data)
        self.sha.update(data)
        self.records += 1
        self.bytes += len(data)

    def close(self, shard: int) -> tuple[str, int, int, int, str]:
        self.out.close()
        final = f"{self.path}/{self.name}"
        if self.at.get_file_info(final).type != fs.FileType.NotFound:
            self.at.delete_file(final)  # by an earlier run of this task: the same bytes
        self.at.move(f"{self.path}/{self.temp}", final)
        return self.name, shard, self.records, self.bytes, self.sha.hexdigest()


def with_roles(pages: DataFrame, least: int) -> DataFrame:
    """Pages with payload and digest, and a row without payload before each that is a revisit.

    Which rows revisit which is worked out on ids and digests alone, so that payloads are
    moved only once, by the shuffle that both kinds of row share.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"), F.lit(None).cast("long").alias("first"))
    ids = rows.where(F.length("payload") >= least).select("page_id", "digest")
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = ids.join(firsts, "digest").where(~F.col("first").eqNullSafe(F.col("page_id"))).distinct().select(
        "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first")
    return rows.union(again)


def shard_of(pages: DataFrame, target: int) -> Column:
    """The shard of a row, from exact byte counts per range of page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    ends = rows.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    width = (hi - lo) // BUCKETS + 1
    bucket = F.coalesce(F.floor((F.col("page_id") - lo) / F.lit(width)), F.lit(-1)).cast("int")
    sizes = {r["b"]: r["n"] for r in rows.groupBy(bucket.alias("b")).agg(
        F.sum(F.col("size") + 600).alias("n")).collect()}  # BUCKETS + 1 rows at most
    start, split, shard, held = {}, {}, 0, 0
    for b in range(-1, BUCKETS):
        n = sizes.get(b, 0)
        if n > target:
            shard += held > 0
            start[b], split[b], held = shard, -(-n // target), 0
            shard += split[b]
        else:
            if held and held + n > target:
                shard, held = shard + 1, 0
            start[b], split[b], held = shard, 1, held + n
    at = [F.lit(start[b]) for b in range(-1, BUCKETS)], [F.lit(split[b]) for b in range(-1, BUCKETS)]
    first, parts = (F.element_at(F.array(*x), bucket + 2) for x in at)
    return (first + F.pmod(F.xxhash64("digest", "page_id"), parts)).cast("int")


def write_warc(pages: DataFrame, folder: str, least: int = 100, roll: int = 64 << 20, shard_bytes: int = 16 << 20,
               date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page into folder; returns the manifest: file, shard, records, bytes, sha256.

    pages needs page_id, url and html (null: empty payload); other columns are not read. Of
    pages with equal payloads of at least `least` bytes, the one with the smallest page_id is
    the response and the others revisit it; rows that repeat that page_id are responses too.
    A null page_id is written without one, and is a response only if no page with an id has
    its payload. A null url is left out. Empty table: no files, an empty manifest.
    """
    rows = with_roles(pages, least).withColumn("shard", shard_of(pages, shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "shard", "records", "bytes", "sha256"]
        now, shard, n, done = None, None, 0, []
        known = None  # page, digest and response of the last row without payload
        for batch in batches:
            for lo, hi in slices(batch, "payload"):
                cols = [batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("shard", "page_id", "url", "payload", "digest", "first")]
                for s, page_id, url, payload, digest, first in zip(*cols, strict=True):
                    if payload is None:
                        known = page_id, digest, first
                        continue
                    first = known[2] if known and known[:2] == (page_id, digest) else None
                    if now and (s != shard or now.bytes >= roll):
                        done.append(now.close(shard))
                        n = n + 1 if s == shard else 0
                        now = None
                    if now is None:
                        n = 0 if s != shard else n
                        now = _File(folder, f"part-{s:06d}-{n:05d}.warc.gz")
                    shard = s
                    now.add(record(page_id, url, payload, digest, first, date))
        if now:
            done.append(now.close(shard))
        cols = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = rows.repartition(parts, "shard").sortWithinPartitions(
        "shard", "page_id", "digest", F.col("payload").isNotNull(), "url").mapInArrow(
        run, "file string, shard int, records long, bytes long, sha256 string")
    made.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(made.schema).parquet(f"{folder}/manifest")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the folder's manifest lists.

    page_id, url, payload (of revisits: empty), payload_bytes, payload_digest, record_type,
    refers_to. Lengths and digests are checked; a damaged file fails the job. Files are read as
    streams, a record at a time.
    """
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(),
             "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with at.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for raw in members(f):
                        rows.append(parsed(raw))
                        held += len(raw)
                        if held > 4_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = spark.read.schema("file string").parquet(f"{folder}/manifest")
    return manifest.repartition(parts, "file").mapInArrow(
        run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def members(f) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    pack, out, left = zlib.decompressobj(31), [], b""
    while True:
        data = left or f.read(1 << 16)
        if not data:
            break
        out.append(pack.decompress(data))
        left = b""
        if pack.eof:
            yield b"".join(out)
            left, pack, out = pack.unused_data, zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("an archive ends within a record")


def op7_warc(spark, sf_dir):
    """Write all pages as archives and read them back."""
    folder = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in DuckDB SQL.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha256(h) AS x FROM p),
f AS (SELECT x, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY x)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.x AS payload_digest,
 CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN f.first <> d.page_id OR d.page_id IS NULL THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.x = f.x
"""
