"""WARC archives with a two-level capture index.

Writing: payloads are grouped by digest first (partial aggregates: a payload that many pages share is one row), and of
each group one page's record is a response and the others' are revisits. Each task writes its pages to one archive of
gzip members and yields an index line for each record. Index lines are sorted by reversed-host key over all tasks; a
task compresses its lines in blocks, and a sparse directory keeps each block's first key and place. Archives, blocks
and directory go to the folder given, by a file system that the executors share; a task that is run again writes new
files, and only those of the attempt that counted are named in the index.

Reading: keys are sorted, so a task reads only the directory's rows between its first key and its last; bisection finds
each key's blocks there, blocks are dealt out and bisected in turn, and records are read by their ranges, neighbours in
an archive by one task. A lookup of one URL goes the same way on its own.

Defined cases: null html is an empty payload, null url is an empty key; equal payloads of at least the bound (0: all)
share one response, that of the largest id; pages that repeat an id are separate records with that id, and those with
the payload and id of the response are responses too; empty tables give empty archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, map_arrow, ship_package, stage

BLOCK_LINES = 3000
#: Bytes of archives that one task reads, about.
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
_INDEX = "key string, page_id bigint, url string, file string, offset bigint, length bigint"


def file_system(path: str):
    """The file system of a URI and the path in it, as executors see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; scheme, user and www. left out."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + rest


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A record's bytes: a response, or a revisit whose HTTP head still names the full payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_field(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields from its bytes; a response's payload is checked against its digest and length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(m[1]) if (m := re.match(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload that it names")
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None, "url": fields["WARC-Target-URI"]}


def _digest(html: Column) -> Column:
    return F.unhex(F.sha1(F.coalesce(html, F.lit("")).cast("binary")))


def _roles(pages: DataFrame, least: int) -> DataFrame:
    """digest, keep: payloads that several pages have, and the page whose record is their response."""
    rows = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    return rows.groupBy(_digest(F.col("html")).alias("digest")).agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep")


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write archives, blocks and directory to folder; pages has page_id, url and html. Returns the directory."""
    spark = pages.sparkSession
    ship_package(spark)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    roles = bounded(_roles(pages, least), "roles")
    # Only where the shared payloads are too many to broadcast does the html itself meet them by a shuffle.
    rows = pages.withColumn("digest", _digest(F.col("html"))).join(roles, "digest", "left")
    rows = rows.select("page_id", "url", F.col("html").cast("binary").alias("html"), F.when(~F.col("keep").eqNullSafe(F.col("page_id")), F.col("keep")).alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        context, out, at, name = TaskContext.get(), None, 0, ""
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(f"{base}/archives", recursive=True)
                name = f"part-{context.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                out = fs.open_output_stream(f"{base}/archives/{name}", compression=None)
            lines: dict[str, list] = {k: [] for k in ("key", "page_id", "url", "file", "offset", "length")}
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                url, data = url.as_py(), gzip.compress(record(page_id.as_py(), url.as_py(), html.as_py(), refers_to.as_py()), 6, mtime=0)
                out.write(data)
                for k, v in zip(lines, (_field(url_key(url)), page_id.as_py(), url, name, at, len(data)), strict=True):
                    lines[k].append(v)
                at += len(data)
            if lines["key"]:
                yield pa.RecordBatch.from_pydict(lines, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    lines = stage(rows.mapInArrow(archive, _INDEX), "lines")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        out, at, name, held, rows = None, 0, "", [], []

        def flush() -> None:
            nonlocal at
            data = zlib.compress("".join(f"{k}\t{line}" for k, line in held).encode(), 6)
            out.write(data)
            rows.append((held[0][0], held[-1][0], name, at, len(data), len(held)))
            at += len(data)
            held.clear()

        for batch in batches:
            for key, page_id, url, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None:
                    fs.create_dir(f"{base}/index", recursive=True)
                    name = f"block-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{base}/index/{name}", compression=None)
                held.append((key, f"{'' if page_id is None else page_id}\t{_field(url)}\t{file}\t{offset}\t{length}\n"))
                if len(held) == BLOCK_LINES:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["first_key", "last_key", "file", "offset", "length", "n"])

    ordered = lines.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    directory = ordered.mapInArrow(blocks, "first_key string, last_key string, file string, offset bigint, length bigint, n bigint")
    path = f"{folder}/directory"
    directory.write.parquet(path)
    return spark.read.parquet(path)


def _range(fs, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as file:
        return file.read_at(length, offset)


def _lines(data: bytes) -> list[list[str]]:
    return [line.split("\t") for line in zlib.decompress(data).decode().split("\n")[:-1]]


def _between(keys: list[str], low: str, high: str) -> slice:
    return slice(bisect.bisect_left(keys, low), bisect.bisect_right(keys, high))


def _blocks_of(key: str, starts: list[str], ends: list[str]) -> range:
    """Places in a sorted directory of the blocks that may hold a key; equal keys may run over several."""
    return range(bisect.bisect_left(ends, key), bisect.bisect_right(starts, key))


def lookup(spark: SparkSession, folder: str, url: str) -> list[dict]:
    """The records of a URL: only its blocks' directory rows are read, then each block by bisection, each record by its range."""
    fs, base = file_system(folder)
    key = _field(url_key(url))
    found = spark.read.parquet(f"{folder}/directory").where((F.col("first_key") <= key) & (F.col("last_key") >= key))
    out = []
    for row in found.collect():
        lines = _lines(_range(fs, f"{base}/index/{row.file}", row.offset, row.length))
        for _, _, _, file, offset, length in lines[_between([x[0] for x in lines], key, key)]:
            out.append(parse(gzip.decompress(_range(fs, f"{base}/archives/{file}", int(offset), int(length)))))
    return sorted(out, key=lambda r: (r["page_id"] is None, r["page_id"]))


def keys_of(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The distinct index keys (key) of URLs."""

    def of(batch: pa.RecordBatch) -> dict:
        return {"key": [_field(url_key(u or "")) for u in batch.column(0).to_pylist()]}

    return map_arrow(urls.select(url_col).distinct(), of, "key string").distinct()


def locate(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """file, offset, length of the records of keys, by bisection of the directory and of blocks."""
    ship_package(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        fs, base = file_system(folder)
        directory = None
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            if not wanted:
                continue
            if directory is None:
                directory = ds.dataset(f"{base}/directory", filesystem=fs, format="parquet")
            near = directory.to_table(filter=(ds.field("first_key") <= wanted[-1]) & (ds.field("last_key") >= wanted[0]))
            near = near.sort_by([(c, "ascending") for c in ("first_key", "last_key", "file", "offset")])
            starts, ends = near.column("first_key").to_pylist(), near.column("last_key").to_pylist()
            at = [(i, k) for k in wanted for i in _blocks_of(k, starts, ends)]
            rows = near.take(pa.array([i for i, _ in at], pa.int64())).select(["file", "offset", "length"])
            yield from rows.append_column("key", pa.array([k for _, k in at], pa.string())).to_batches()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        opened, block, keys = None, [], []
        for batch in batches:
            out: dict[str, list] = {"file": [], "offset": [], "length": []}
            for file, offset, length, key in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if opened != (file, offset):
                    block, opened = _lines(_range(fs, f"{base}/index/{file}", offset, length)), (file, offset)
                    keys = [x[0] for x in block]
                for line in block[_between(keys, key, key)]:
                    out["file"].append(line[3])
                    out["offset"].append(int(line[4]))
                    out["length"].append(int(line[5]))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    found = keys.select("key").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(blocks, "file string, offset bigint, length bigint, key string")
    return found.repartition("file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(lines, "file string, offset bigint, length bigint")


def read(spark: SparkSession, folder: str, urls: DataFrame, url_col: str = "url", payloads: bool = False) -> DataFrame:
    """The records of URLs: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    return _records(stage(locate(spark, folder, keys_of(urls, url_col)), "places"), folder, payloads)


def read_all(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Every record that the index names, with the columns of read()."""
    ship_package(spark)

    def entries(batch: pa.RecordBatch) -> dict:
        fs, base = file_system(folder)
        out: dict[str, list] = {"file": [], "offset": [], "length": []}
        for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for line in _lines(_range(fs, f"{base}/index/{file}", offset, length)):
                out["file"].append(line[3])
                out["offset"].append(int(line[4]))
                out["length"].append(int(line[5]))
        return out

    directory = spark.read.parquet(f"{folder}/directory")
    return _records(stage(map_arrow(directory.select("file", "offset", "length"), entries, "file string, offset bigint, length bigint"), "places"), folder, payloads)


def _records(places: DataFrame, folder: str, payloads: bool) -> DataFrame:
    # Neighbours in an archive go to one task, large archives to several.
    stretch = F.floor(F.col("offset") / F.lit(READ_BYTES))
    tasks = max(1, -(-int(places.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    found = places.repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *["payload"] * payloads]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        opened, file = None, None
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name != opened:
                    if file is not None:
                        file.close()
                    file, opened = fs.open_input_file(f"{base}/archives/{name}"), name
                got = parse(gzip.decompress(file.read_at(length, offset)))
                for k in names:
                    out[k].append(got[k])
            kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, kinds.get(k, pa.string())) for k in names]))
        if file is not None:
            file.close()

    kinds = {"page_id": "bigint", "payload_bytes": "bigint", "refers_to": "bigint", "payload": "binary"}
    return found.mapInArrow(records, ", ".join(f"{k} {kinds.get(k, 'string')}" for k in names))
