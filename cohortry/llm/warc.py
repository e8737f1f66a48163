"""WARC archives from a table of pages: sorted shards, files cut by compressed size.

A shard is a range of page ids whose payloads add up to about ``shard_bytes``; its bounds follow
from the table alone, so two runs give the same files.  Inside a shard records are written in order
of the page id, one gzip member each, and a file ends when its compressed size reaches
``file_bytes``.  Headers, digests and lengths are made anew from the payload.  Files are written
under temporary names and renamed; the manifest, one row per file, is committed last by Spark, and a
folder without it is not whole.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import put_file
from cohortry.operators.ranking import running_totals

#: More shards than this are never made: the shard grows instead.
MOST_SHARDS = 100_000
#: Payloads below this are always written in full.
LEAST_REVISIT = 1000


def _annotated(pages: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The rows with payload, length and digests, and the (page_id, sha, refers_to) of the revisits."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha": F.sha2("payload", 256)})
    slim = rows.where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "sha")
    last = slim.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to")
    return rows, slim.distinct().join(last.drop("least"), "sha").where("page_id < refers_to").select("page_id", "sha", "refers_to")


def _bounds(rows: DataFrame, shard_bytes: int) -> list[float]:
    """The page ids at which a shard starts, but for the first."""
    per_key = rows.where("page_id is not null").groupBy("page_id").agg(F.sum(F.col("bytes") + 400).cast("long").alias("bytes"))
    total = per_key.agg(F.sum("bytes")).first()[0] or 0
    size = max(shard_bytes, -(-total // MOST_SHARDS))
    if total <= size:
        return []
    run = running_totals(per_key, ["page_id"], {"upto": "bytes"})
    shard = F.expr(f"(upto - bytes) div {size}")
    starts = run.select("page_id", shard.alias("shard")).where("shard > 0").groupBy("shard").agg(F.min("page_id").alias("at"))
    return sorted({float(r["at"]) for r in starts.collect()})


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + b"\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c for c in (url or "") if c.isprintable())
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _member(headers, block)


def _info(name: str, date: str) -> bytes:
    block = b"software: cohortry\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))], block)


def write(pages: DataFrame, folder: str, shard_bytes: int = 1 << 30, file_bytes: int = 32 << 20, date: str = "2000-01-01T00:00:00Z", least_revisit: int = LEAST_REVISIT) -> None:
    """Write (page_id, url, html) as WARC archives to a new folder.

    A NULL html is an empty payload, a NULL url an empty one.  Of equal payloads of at least
    ``least_revisit`` bytes the one with the largest page id is written in full, the others as
    revisits of it; rows that repeat its page id as well are written in full.  A NULL page id has an
    empty name, comes first and is always written in full.  Other columns are ignored.  An empty
    table gives an empty manifest.

    The payloads are shuffled once.  What marks the revisits travels beside them as narrow rows of
    the same shard, so no join moves a payload, and however many pages share one, they stay spread.
    """
    rows, revisits = _annotated(pages, least_revisit)
    bounds = _bounds(rows, shard_bytes)
    both = rows.select("page_id", "sha", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    )
    # Two ids may be the same double: they stay in one shard then.
    both = both.withColumn("at", F.coalesce(F.col("page_id").cast("double"), F.lit(float("-inf"))))
    if bounds:
        both = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="at", outputCol="shard").transform(both)
    else:
        both = both.withColumn("shard", F.lit(0.0))
    both = both.withColumn("shard", F.col("shard").cast("int"))
    dealt = both.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "sha", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, number, size, n, mark = [], None, 0, 0, 0, None

        def put():
            nonlocal out, number, size, n
            name = f"shard-{shard:07d}-{number:05d}.warc.gz"
            put_file(f"{folder}/data", name, [_info(name, date), *out])
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])
            out, number, size, n = [], number + 1, 0, 0
            return row

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("shard", "page_id", "sha", "kind", "url", "refers_to")]
            for i, (s, page, sha, kind, url, refers) in enumerate(zip(*cols)):
                if s != shard:
                    if n:
                        yield put()
                    shard, number = s, 0
                if kind == 0:
                    mark = (page, sha, refers)
                    continue
                to = mark[2] if mark is not None and mark[:2] == (page, sha) else None
                record = _record(page, url, b.column("payload")[i].as_py(), to, date)
                out.append(record)
                size, n = size + len(record), n + 1
                if size >= file_bytes:
                    yield put()
        if n:
            yield put()

    columns = ["shard", "page_id", "sha", "kind", "url", "refers_to", "payload"]
    dealt.select(*columns).mapInArrow(run, "file string, records long, bytes long").write.parquet(f"{folder}/manifest")


def _members(content: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, one after the other."""
    at, view = 0, memoryview(content)
    while at < len(view):
        # fed in short steps: what follows a member is handed back as a copy
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a member is cut off")
            parts.append(z.decompress(view[at : at + 8192]))
            at = min(at + 8192, len(view)) - len(z.unused_data)
        yield b"".join(parts)


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    ``payload`` is NULL for a revisit.  Digests are checked against what was read; lengths and
    digests are those of the full payload in either case.  Raises if the manifest lists other files
    than there are, or a record is damaged.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/data")
    have, listed = files.select("path").count(), manifest.count()
    if have != listed:
        raise ValueError(f"{have} archives, {listed} in the manifest")

    def page(name):
        digits = name[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for content in b.column(0):
                out, held = [], 0
                for data in _members(content.as_py()):
                    h, block = _parse(data)
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    full = h["warc-type"] == "response"
                    if _sha1(block) != h["warc-block-digest"] or full and (len(payload) != length or _sha1(payload) != h["warc-payload-digest"]):
                        raise ValueError(f"{h['warc-record-id']} does not match its digest")
                    digest = base64.b32decode(h["warc-payload-digest"][5:]).hex()
                    refers = None if full else page(h["warc-refers-to"])
                    out.append((page(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], refers, length, digest, payload if full else None))
                    held += len(block)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return files.select("content").mapInArrow(run, schema)
