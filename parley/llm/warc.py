"""WARC archives as a PySpark Python data source (format "warc").

Reading: one partition per stretch of about `split_bytes` of an archive (the manifest knows where records begin).
Predicates on the record type, URI and other header fields are pushed into the source. Each record is a gzip member whose
extra field "sl" holds its packed and unpacked lengths: the reader inflates a member STEP bytes at a time until the header
block ends, tests the pushed predicates, and jumps to the next member; a payload is inflated only where it is wanted (option
payload, default true) and the record passes. Archives are fetched `ahead_bytes` at a time, so that small records do not
cost a request each on an object store.

Writing: each task writes an archive under a name of its own; the commit lists those of the tasks that won in a manifest,
so what lost or repeated attempts leave behind is never read. Paths are opened by pyarrow's file systems (file, hdfs, s3,
gs), not by the local open().

Defined cases: a null page is an empty payload; a null page id is the record id <urn:page>, any other is part of it as
in a URL, so ids may be of any type with an order (an empty text comes back as null); equal payloads with
equal greatest ids are all responses; repeated rows are records of their own. Outer blanks of a URI come back, line breaks
in it do not. An empty table makes an archive folder without records. register() leaves Python filter pushdown on in the
session, which readers need when their query is planned, after this module is done.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from parley.llm._common import materialize, q, scratch, spread_join

#: Column -> header field. Columns of the source besides payload.
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
    "profile": "WARC-Profile",
}
#: What a revisit of an equal payload says it is, so that any reader can resolve it.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ", ".join(f"{c} {'long' if c == 'payload_bytes' else 'string'}" for c in FIELDS) + ", payload binary"
END = b"\r\n\r\n"
#: Bytes that are inflated at a time while a header is looked for.
STEP = 512


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """data as one gzip member that says how long it is."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    length = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, length, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(header: dict[str, str], payload: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in header.items()), f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + END + payload + END


def parse_header(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.removeprefix(" ")
    return out


class Ahead:
    """Reads of a file in order, fetched `size` bytes at a time; a jump inside what is held costs nothing."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.low, self.held = file, size, 0, 0, b""

    def seek(self, at: int) -> None:
        self.at = at

    def tell(self) -> int:
        return self.at

    def read(self, n: int) -> bytes:
        if not self.low <= self.at <= self.at + n <= self.low + len(self.held):
            self.file.seek(self.at)
            self.low, self.held = self.at, self.file.read(max(n, self.size))
        out = self.held[self.at - self.low : self.at - self.low + n]
        self.at += len(out)
        return out


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    starts: list[int]
    size: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.split = int(options.get("split_bytes", 32 << 20))
        self.ahead = int(options.get("ahead_bytes", 4 << 20))
        self.wanted = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, tuple[str, ...]]] = []
        self.inflated = 0  # bytes, by this copy of the reader

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in FIELDS and column != "payload_bytes" and isinstance(f, EqualTo):
                self.tests.append((FIELDS[column].lower(), "is", (f.value,)))
            elif column in FIELDS and column != "payload_bytes" and isinstance(f, In):
                self.tests.append((FIELDS[column].lower(), "is", tuple(f.value)))
            elif column in FIELDS and column != "payload_bytes" and isinstance(f, StringStartsWith):
                self.tests.append((FIELDS[column].lower(), "starts", (f.value,)))
            else:
                yield f

    def partitions(self):
        files, path = _open(self.path)
        try:
            with files.open_input_stream(f"{path}/manifest.json") as f:
                listed = json.loads(f.read())
        except FileNotFoundError:  # archives of another origin: a partition is a whole file
            found = files.get_file_info(fs.FileSelector(path))
            return [Part(f"{self.path}/{x.base_name}", 0, x.size) for x in found if x.base_name.endswith((".warc", ".warc.gz"))]
        out = []
        for name, starts, size in listed:
            bounds = [*starts, size]
            out += [Part(f"{self.path}/{name}", a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return out or [Part("", 0, 0)]

    def _passes(self, header: dict[str, str]) -> bool:
        return all((k in header) and (header[k] in vs if how == "is" else header[k].startswith(vs)) for k, how, vs in self.tests)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for header, payload in self._records(partition) if partition.path else ():
            values = [header.get(k.lower()) for k in FIELDS.values()]
            at = list(FIELDS).index("payload_bytes")
            values[at] = None if values[at] is None else int(values[at])
            rows.append((*values, payload))
            held += len(payload or b"")
            if held > 1 << 23 or len(rows) >= 5000:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if c == "payload_bytes" else pa.string() for c in FIELDS] + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*FIELDS, "payload"])

    def _records(self, part: Part) -> Iterator[tuple[dict[str, str], bytes | None]]:
        files, path = _open(part.path)
        with files.open_input_file(path) as file:
            f, at = Ahead(file, min(self.ahead, max(part.end - part.start, 1 << 12))), part.start
            while at < part.end:
                f.seek(at)
                head = f.read(1 << 12)
                if head[:2] != b"\x1f\x8b":
                    yield from self._plain(f, at, part.end)
                    return
                length = None
                if head[3] & 4 and head[12:14] == b"sl":
                    length = struct.unpack("<I", head[16:20])[0]
                inflate, data, feed = zlib.decompressobj(31), b"", head
                while END not in data and not inflate.eof:
                    got = inflate.decompress(feed, STEP)
                    feed = inflate.unconsumed_tail
                    if not got and not feed:
                        feed = f.read(1 << 12)
                        if not feed:
                            break
                    data += got
                self.inflated += len(data)
                block, _, rest = data.partition(END)
                header = parse_header(block)
                passes = self._passes(header)
                if length is None or (passes and self.wanted):
                    parts = [rest]
                    while not inflate.eof:
                        feed = inflate.unconsumed_tail or feed or f.read(1 << 16)
                        if not feed:
                            break
                        got, feed = inflate.decompress(feed, 1 << 20), b""
                        self.inflated += len(got)
                        if passes and self.wanted:
                            parts.append(got)
                    if length is None:
                        length = f.tell() - at - len(inflate.unused_data)
                    payload = b"".join(parts)[: int(header.get("content-length", 0))]
                if passes:
                    yield header, payload if self.wanted else None
                at += length

    def _plain(self, f, at: int, end: int) -> Iterator[tuple[dict[str, str], bytes | None]]:
        while at < end:
            f.seek(at)
            data = b""
            while END not in data:
                more = f.read(1 << 12)
                if not more:
                    return
                data += more
            block = data.partition(END)[0]
            header = parse_header(block)
            size = int(header.get("content-length", 0))
            if self._passes(header):
                f.seek(at + len(block) + 4)
                yield header, f.read(size) if self.wanted else None
            at += len(block) + 4 + size + 4


class Writer(DataSourceArrowWriter):
    """Rows (header fields as columns, payload binary) -> an archive for each task."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.split = int(options.get("split_bytes", 32 << 20))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, path = _open(self.path)
        files.create_dir(path, recursive=True)
        name, starts, size = f"part-{uuid.uuid4().hex}.warc.gz", [], 0
        with files.open_output_stream(f"{path}/{name}", compression=None) as out:
            for b in iterator:
                columns = {c: b.column(c) for c in b.schema.names}
                for i in range(b.num_rows):
                    header = {FIELDS[c]: str(v) for c in FIELDS if c in columns and (v := columns[c][i].as_py()) is not None}
                    data = member(record(header, columns["payload"][i].as_py() or b""))
                    if not starts or size - starts[-1] >= self.split:
                        starts.append(size)
                    out.write(data)
                    size += len(data)
        return Written(name, starts, size)

    def commit(self, messages) -> None:
        files, path = _open(self.path)
        files.create_dir(path, recursive=True)
        listed: list = []
        if not self.overwrite:
            try:
                with files.open_input_stream(f"{path}/manifest.json") as f:
                    listed = json.loads(f.read())
            except FileNotFoundError:
                pass
        listed += [[m.name, m.starts, m.size] for m in messages if m and m.size]
        with files.open_output_stream(f"{path}/manifest.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages) -> None:
        files, path = _open(self.path)
        for m in messages:
            if m:
                files.delete_file(f"{path}/{m.name}")


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least: int = 1000) -> DataFrame:
    """One record for each page: a payload of at least `least` bytes that a greater id also has becomes a revisit of it."""
    html = F.coalesce(F.col("html"), F.lit(""))
    raw = pages.select(q(id_col).alias("page_id"), q(html_col).alias("html"), q(url_col).alias("url"))
    rows = raw.select("page_id", "url", html.cast("binary").alias("body"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("sha"))
    long = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "sha")
    first = long.groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first, "payloads")
    again = spread_join(rows, first, ["sha"], pages.count(), "n", "left").withColumn("again", F.coalesce((F.col("first") > F.col("page_id")) & (F.col("payload_bytes") >= least), F.lit(False)))
    urn = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")), F.lit("<urn:page>"))
    return again.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        F.regexp_replace("url", r"[\r\n]", "").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha1:"), "sha").alias("payload_digest"),
        "payload_bytes",
        F.when(F.col("again"), urn(F.col("first"))).alias("refers_to"),
        F.lit("text/html").alias("content_type"),
        F.when(F.col("again"), IDENTICAL).alias("profile"),
        F.when(~F.col("again"), F.col("body")).alias("payload"),
    )


def archive(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Write a record for each page; the folder of archives."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch(spark, "warc")
    plan_records(pages, **columns).write.format("warc").mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def digest(records: DataFrame, kind: str = "long") -> DataFrame:
    """The contract's columns, from records as read back: of responses by their payloads, of revisits by their headers.

    kind: the type of the pages' ids."""
    number = lambda c: F.url_decode(F.nullif(F.regexp_extract(c, "(?s)^<urn:page:(.*)>$", 1), F.lit(""))).cast(kind)
    full = F.col("record_type") == "response"
    return records.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.substring("payload_digest", 6, 40)).alias("payload_digest"),
        "record_type",
        F.when(~full, number(F.col("refers_to"))).alias("refers_to"),
    )


