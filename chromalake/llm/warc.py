"""WARC archives as a Spark data source written in Python.

Reading.  One partition per archive file; files are listed on the driver.  A path is a folder
or one file.  Comparisons of a column that comes from a header (PUSHED, the date's ranges,
and the headers that the option ``headers`` names) are pushed into the reader, which parses a
record's headers first and neither decompresses further than needed into objects nor decodes
the payload of a record that a filter rejects, or of any record when the option ``payload``
is ``false`` or the column is not asked for.  Archives may be plain or gzip of any number of
members, by this module or by others: of records without ``X-Page-Id`` the page id is null.
The payload of an ``application/http`` block is what follows its header, any other block is
the payload; a revisit has none.

Writing.  Each task writes one file under a name of its own attempt, and the driver's commit
names the files that count in a manifest of the job (``_MANIFEST-<id>.json``); a repeated or
lost task leaves at most a file that no reader opens.  A folder's records are those of all
its manifests, so appending adds to them; overwriting removes the manifests, then the files,
that were there.  A folder without a manifest is read file by file (``*.warc``, ``*.warc.gz``).
Paths are URIs of any file system that pyarrow knows.

Deduplication.  Of records with equal payloads of at least ``least`` bytes the one with the
smallest page id is a response, the others are revisits that name it and carry no payload
but its length and digest.  Rows of a digest that very many rows share get their response
from a broadcast table of a bounded number of such digests, so no task meets all of them.

Edge cases: a null payload is empty; a null page id is written as an empty header and read
back as null, and sorts after every other id when the response of a group is chosen; rows
that share the smallest id are all responses; payloads below ``least`` bytes are all
responses; a payload is held whole, as a cell of a row is; an empty table gives archives
without records; columns other than id, URL and payload are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from chromalake.llm.components import hub_size
from chromalake.runtime import scratch_path, ship_package

SCHEMA = (
    "page_id long, record_type string, record_id string, target_uri string, warc_date string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)
#: Columns that come from headers; equality, membership, order and prefixes are pushed down.
PUSHED = ("page_id", "record_type", "record_id", "target_uri", "warc_date", "refers_to")
LEAST = 100
_BATCH_BYTES = 8 << 20


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _clean(value) -> str:
    """A header value on one line."""
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def encode_record(page_id, url, record_type: str, refers_to, digest: str, size: int, payload: bytes) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if record_type == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:page:{_clean(page_id)}>",
        f"WARC-Target-URI: {_clean(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {_clean(page_id)}",
        f"X-Payload-Length: {size}",
    ]
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


class _Bytes:
    """Sequential reads over a plain stream or its gzip members, with a skip that keeps nothing."""

    def __init__(self, stream):
        self.stream, self.z, self.buf = stream, None, bytearray()
        self.raw = self.stream.read(1 << 20)
        self.plain = self.raw[:2] != b"\x1f\x8b"

    def _more(self) -> bool:
        if self.plain:
            self.buf += self.raw
            got, self.raw = bool(self.raw), self.stream.read(1 << 20)
            return got
        while True:
            if self.z is None or self.z.eof:
                if self.z is not None:
                    self.raw = self.z.unused_data
                if not self.raw:
                    self.raw = self.stream.read(1 << 20)
                if not self.raw:
                    return False
                self.z = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(1 << 20)
                if not self.raw:
                    return False
            got = self.z.decompress(self.raw, 1 << 20)
            self.raw = b"" if self.z.eof else self.z.unconsumed_tail
            if got:
                self.buf += got
                return True

    def line(self) -> bytes | None:
        while (k := self.buf.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.buf[:k])
        del self.buf[: k + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self._more():
            pass
        out = bytes(self.buf[:n])
        del self.buf[:n]
        if len(out) < n:
            raise EOFError("a record ends before its length")
        return out

    def skip(self, n: int) -> None:
        while n:
            if not self.buf and not self._more():
                raise EOFError("a record ends before its length")
            k = min(n, len(self.buf))
            del self.buf[:k]
            n -= k


def records(stream, wanted=lambda head: True, payload: bool = True) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, payload or None) of the records that ``wanted`` accepts by their headers."""
    data = _Bytes(stream)
    while (version := data.line()) is not None:
        if not version:
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        head: dict[str, str] = {}
        while line := data.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head.get("content-length", 0))
        want = wanted(head)
        if want and payload and head.get("warc-type") != "revisit":
            block = data.take(size)
            http = head.get("content-type", "").replace(" ", "").lower().startswith("application/http")
            cut = block.find(b"\r\n\r\n") if http else -4
            yield head, block[cut + 4 :] if cut != -1 else b""
        else:
            data.skip(size)
            if want:
                yield head, None


def _number(x: str | None) -> int | None:
    return int(x) if x and x.lstrip("-").isdigit() else None


#: How a column is read from the headers.
_FIELDS = {
    "page_id": lambda h: _number(h.get("x-page-id")),
    "record_type": lambda h: h.get("warc-type"),
    "record_id": lambda h: h.get("warc-record-id"),
    "target_uri": lambda h: h.get("warc-target-uri"),
    "warc_date": lambda h: h.get("warc-date"),
    "refers_to": lambda h: _number(h.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")),
    "payload_bytes": lambda h: _number(h.get("x-payload-length")),
    "payload_digest": lambda h: h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
}


def _named(options) -> dict[str, str]:
    """Column -> header of the option ``headers``: names in any case, parted by commas; '-' becomes '_'."""
    names = [x.strip().lower() for x in options.get("headers", "").split(",")]
    return {x.replace("-", "_"): x for x in names if x}


class WarcPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


#: Tests of pushed comparisons; a null never passes.
_TESTS = {
    EqualTo: lambda x, value: x == value,
    In: lambda x, value: x in value,
    GreaterThan: lambda x, value: x > value,
    GreaterThanOrEqual: lambda x, value: x >= value,
    LessThan: lambda x, value: x < value,
    LessThanOrEqual: lambda x, value: x <= value,
    StringStartsWith: lambda x, value: x.startswith(value),
}


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.path = options["path"].rstrip("/")
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.named = _named(options)
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and (name in PUSHED or name in self.named):
                self.tests.append((name, type(f).__name__, f.value))
            else:
                yield f

    def partitions(self):
        return [WarcPartition(f) for f in archive_files(self.path)]

    def read(self, partition):
        if partition is None:  # no file at all
            return
        fs, path = _fs(partition.path)
        get = {c: _FIELDS[c] for c in _FIELDS} | {c: lambda h, k=k: h.get(k) for c, k in self.named.items()}
        tests = [(get[c], next(t for k, t in _TESTS.items() if k.__name__ == kind), value) for c, kind, value in self.tests]
        wanted = lambda head: all((x := g(head)) is not None and t(x, value) for g, t, value in tests)
        types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        rows: list[dict] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in self.names], self.names)

        # a length that no header tells is that of the payload
        body_too = self.payload and ("payload" in self.names or "payload_bytes" in self.names)
        with fs.open_input_stream(path, compression=None) as stream:
            for head, body in records(stream, wanted, body_too):
                row = {c: body if c == "payload" else get[c](head) for c in self.names}
                if "payload_bytes" in row and row["payload_bytes"] is None and body is not None:
                    row["payload_bytes"] = len(body)
                rows.append(row)
                held += len(body or b"") + 200
                if held >= _BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


def archive_files(path: str) -> list[str]:
    """The archives that count under a path: those of its manifests, else every ``*.warc`` and ``*.warc.gz``."""
    from pyarrow import fs as pafs

    fs, root = _fs(path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [path]
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File)
    manifests = [n for n in names if n.startswith("_MANIFEST-") and n.endswith(".json")]
    if manifests:
        names = []
        for m in manifests:
            with fs.open_input_stream(f"{root}/{m}") as f:
                names += json.loads(f.read())
    return [f"{path}/{n}" for n in sorted(names) if n.endswith((".warc", ".warc.gz"))]


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class WarcWriter(DataSourceArrowWriter):
    """Rows (page_id, url, record_type, refers_to, payload_digest, payload string)."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            if out is None and batch.num_rows:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            for r in batch.to_pylist():
                body = (r["payload"] or "").encode()
                out.write(encode_record(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"], len(body), body))
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages):
        from pyarrow import fs as pafs

        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        own = sorted(m.name for m in messages if m and m.name)
        manifest = f"_MANIFEST-{uuid.uuid4().hex}.json"
        old = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and f.base_name not in own] if self.overwrite else []
        with fs.open_output_stream(f"{root}/{manifest}") as f:
            f.write(json.dumps(own).encode())
        for f in sorted(old, key=lambda f: not f.base_name.startswith("_MANIFEST-")):  # manifests first
            if f.base_name.startswith("_MANIFEST-") or f.base_name.endswith((".warc", ".warc.gz")):
                fs.delete_file(f.path)

    def abort(self, messages):
        """Files of a failed job stay unnamed and are never read."""


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return ", ".join([SCHEMA, *(f"{c} string" for c in _named(self.options))])

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite)


def register(spark) -> None:
    ship_package(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def digest(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


def plan_records(pages: DataFrame, least: int = LEAST, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Adds each row's digest, record type and the response it refers to.

    Digests meet in an aggregation with map-side combination; only repeated ones go into the
    join, whose strategy Spark picks by the measured size of that side.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    hashed = base.withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    heads = (
        hashed.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and head is not null")
    )
    # digests that many rows share, a bounded number, are told without a shuffle; the others meet by digest
    common = heads.where(F.col("n") > hub_size(pages.count())).select("payload_digest", F.col("head").alias("_common"))
    near = hashed.join(F.broadcast(common), "payload_digest", "left").withColumn("_key", F.when(F.col("_common").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")))))
    joined = near.join(heads.select(F.col("payload_digest").alias("_key"), F.col("head").alias("_head")), "_key", "left").withColumn("head", F.coalesce("_common", "_head"))
    revisit = F.coalesce(F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.lit(False))
    return joined.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("head")).alias("refers_to"), "payload_digest", "payload")


def write_archives(pages: DataFrame, path: str, mode: str = "append", **columns) -> None:
    """Writes one record per row under ``path``; mode is append or overwrite."""
    register(pages.sparkSession)
    plan_records(pages, **columns).write.format("warc").mode(mode).save(path)


def read_archives(spark, path: str, payload: bool = True, headers: str = "") -> DataFrame:
    """Records under ``path``; ``headers`` names further headers, parted by commas, that become columns."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("headers", headers).load(path)


def op5_warc_source(spark, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC records and reads the archives back."""
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = read_archives(spark, path)
    # of responses the digest and length come from the payload as read
    full = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to")
