"""WARC archives as a PySpark Python data source, both ways.

Reading: one partition for each group of whole files; predicates on record type and headers are pushed down and
tested on the parsed WARC header before anything else of a record; a payload is decoded only if its record
passes and the schema asks for it. Compressed archives hold one gzip member a record; each member carries its
compressed length in an `sl` extra field, so that a reader can seek past it.

Writing: each task writes archives of bounded size under names of its own; the driver's commit lists them in a
manifest, and readers go by the manifests, so a lost task or a second attempt leaves nothing visible. An overwriting
commit's manifest names those that it replaces: from then on they don't count, whether or not they are deleted yet.

Paths may be file:, hdfs:, s3: or whatever else pyarrow.fs resolves.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import small, written

SCHEMA = (
    "warc_type string, record_id string, warc_date string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, headers map<string,string>, payload binary, digest_ok boolean"
)
#: Columns that stand in the WARC header, with its field names.
FIELDS = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "warc_date": "warc-date",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
#: An empty line: the end of a head.
BLANK = re.compile(rb"\r?\n\r?\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARROW = pa.schema(
    [(c, pa.string()) for c in FIELDS] + [("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("digest_ok", pa.bool_())]
)
#: Columns for which a payload is decoded.
DECODED = {"payload", "digest_ok"}
#: Bytes after which a task starts another archive, and bytes of archives in a partition.
FILE_BYTES = 128_000_000
SPLIT_BYTES = 64_000_000
#: Records and bytes of payload in a batch read.
BATCH_ROWS, BATCH_BYTES = 2000, 8_000_000


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _value(text: str) -> str:
    """A header value: control characters and line ends in percent form."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(row: dict) -> bytes:
    """One record. A revisit keeps the digest and the HTTP header, with the full payload's length, but no payload."""
    payload = row.get("payload") or b""
    revisit = row["warc_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", row["warc_type"]),
        ("WARC-Record-ID", row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", row.get("warc_date") or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", row.get("target_uri")),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", row.get("refers_to") if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {_value(v)}\r\n" for k, v in head if v is not None) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose `sl` extra field has its compressed and its plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff"
    extra = b"sl" + struct.pack("<HII", 8, len(head) + 2 + 12 + len(body) + 8, len(record))
    return head + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class _Source:
    """Bytes of an archive in order, as it is or inflated member by member."""

    def __init__(self, file, packed: bool):
        self.file, self.packed, self.buffer, self.done = file, packed, b"", False
        self.unzip, self.raw, self.start, self.length, self.plain = None, b"", 0, 0, 0

    def _more(self) -> bool:
        """Add to the buffer; False at the end."""
        if not self.packed:
            data = self.file.read(1 << 16)
            self.buffer += data
            return bool(data)
        while True:
            if self.unzip is None and not self._member():
                return False
            if not self.raw:
                self.raw = self.file.read(1 << 14)
                if not self.raw:
                    raise EOFError("an archive ends inside a member")
            data = self.unzip.decompress(self.raw, 1 << 16)
            self.raw = self.unzip.unconsumed_tail
            if self.unzip.eof:
                self.raw, self.unzip = self.unzip.unused_data, None
            if data:
                self.buffer += data
                return True

    def _member(self) -> bool:
        """Begin the next member, noting the length that its extra field tells."""
        if len(self.raw) < 64:
            self.raw += self.file.read(1 << 14)
        if not self.raw:
            return False
        self.start, self.length, self.plain = self.file.tell() - len(self.raw), 0, 0
        if self.raw[:4] == b"\x1f\x8b\x08\x04" and self.raw[12:14] == b"sl":
            self.length, self.plain = struct.unpack("<II", self.raw[16:24])
        self.unzip = zlib.decompressobj(31)
        return True

    def head(self) -> tuple[bytes, int] | None:
        """Everything up to the next empty line, and the bytes that it took with that line; None at the end."""
        while True:
            while self.buffer[:1] in (b"\r", b"\n"):
                self.buffer = self.buffer.lstrip(b"\r\n")
            if m := BLANK.search(self.buffer):
                found, self.buffer = self.buffer[: m.start()], self.buffer[m.end() :]
                return found, m.end()
            if not self._more():
                return None

    def http_head(self, n: int) -> tuple[bytes, int]:
        """The head of an HTTP message in the next n bytes and the bytes that it takes; none if they hold no empty line."""
        while not (m := BLANK.search(self.buffer[:n])) and len(self.buffer) < n:
            if not self._more():
                raise EOFError("an archive ends inside a record")
        if not m:
            return b"", 0
        found, self.buffer = self.buffer[: m.start()], self.buffer[m.end() :]
        return found, m.end()

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._more():
                raise EOFError("an archive ends inside a record")
            parts.append(self.buffer)
            have += len(self.buffer)
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]

    def skip(self, n: int, record: int) -> None:
        """Leave out n bytes; record: the bytes of the whole record with its end. If those are all of a member whose
        compressed length is known, the next member is sought at once."""
        if self.packed and self.length and self.plain == record:
            self.file.seek(self.start + self.length)
            self.unzip, self.raw, self.buffer = None, b"", b""
        elif not self.packed and n > len(self.buffer):
            self.file.seek(self.file.tell() + n - len(self.buffer))
            self.buffer = b""
        else:
            while n > len(self.buffer):
                n -= len(self.buffer)
                self.buffer = b""
                if not self._more():
                    raise EOFError("an archive ends inside a record")
            self.buffer = self.buffer[n:]


def parsed(head: bytes) -> dict[str, str]:
    lines = re.split("\r?\n", head.decode("utf-8", "replace"))
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(file, packed: bool, wanted: set[str], passes) -> Iterator[dict]:
    """Records whose header passes; only wanted columns are decoded.

    A record is the bytes that its content-length tells, whatever they are. An HTTP message without an empty line among
    them has no head, and all of them are its payload; lines may end in LF alone. A record without a content-length
    is empty. An archive that ends inside a record, or goes on with something else than a record, is an error.
    """
    source = _Source(file, packed)
    while (found := source.head()) is not None:
        head, taken = found
        fields = parsed(head)
        n = int(fields.get("content-length", 0))
        whole = taken + n + 4
        row = {c: fields.get(f) for c, f in FIELDS.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if not passes(row):
            source.skip(n, whole)
            continue
        row["headers"] = list(fields.items()) if "headers" in wanted else None
        if not wanted & {"payload_bytes", *DECODED}:
            source.skip(n, whole)
            yield row
            continue
        http, size = b"", n
        if fields.get("content-type", "").startswith("application/http"):
            http, before = source.http_head(n)
            size = n - before
        revisit = row["warc_type"] == "revisit"
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http) if revisit else None
        row["payload_bytes"] = int(length[1]) if length else size
        if wanted & DECODED and not revisit:
            payload = source.take(size)
            row["payload"] = payload if "payload" in wanted else None
            row["digest_ok"] = digest_of(payload) == row["payload_digest"] if row["payload_digest"] else None
        else:
            source.skip(size, whole)
        yield row


@dataclass
class Files(ds.InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        self.paths = paths


def _manifests(files: fs.FileSystem, paths: list[str]) -> tuple[list[str], set[str]]:
    """The manifests among these paths that no other one replaces, and the archives that they list."""
    read = {p: json.loads(files.open_input_file(p).readall()) for p in paths if re.search(r"(^|/)_manifest-[^/]*\.json$", p)}
    gone = {name for m in read.values() for name in m["replaces"]}
    now = [p for p in read if p.rsplit("/", 1)[-1] not in gone]
    return now, {n for p in now for n in read[p]["archives"]}


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.columns, self.path, self.tests = schema.names, path, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Predicates on header columns are tested here; Spark keeps the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in FIELDS and isinstance(f, (ds.EqualTo, ds.In, ds.IsNotNull, ds.IsNull, ds.StringStartsWith)):
                self.tests.append((type(f).__name__, column, getattr(f, "value", None)))
            else:
                yield f

    def passes(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            x = row[column]
            if kind == "IsNull":
                ok = x is None
            elif x is None:
                ok = False
            else:
                ok = {"EqualTo": lambda: x == value, "In": lambda: x in value, "IsNotNull": lambda: True, "StringStartsWith": lambda: x.startswith(value)}[kind]()
            if not ok:
                return False
        return True

    def partitions(self) -> list[Files]:
        files, root = filesystem(self.path)
        found = {f.path: f.size for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file} if files.get_file_info(root).type == fs.FileType.Directory else {root: files.get_file_info(root).size}
        manifests, names = _manifests(files, list(found))
        archives = sorted((p for p in found if re.search(r"\.warc(\.gz)?$", p) and (not manifests or p.rsplit("/", 1)[-1] in names)), key=lambda p: (-found[p], p))
        groups: list[list[str]] = []
        room = 0
        for p in archives:
            if not groups or found[p] > room:
                groups.append([])
                room = SPLIT_BYTES
            groups[-1].append(p)
            room -= found[p]
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.path)
        schema = pa.schema([ARROW.field(c) for c in self.columns])
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with files.open_input_file(path) as file:
                for row in records(file, path.endswith(".gz"), set(self.columns), self.passes):
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class Archives(ds.WriterCommitMessage):
    names: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, packed: bool, level: int, overwrite: bool):
        self.path, self.packed, self.level, self.overwrite = path, packed, level, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        from pyspark import TaskContext

        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                columns = {c.lower(): batch.column(i) for i, c in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    if out is None or size >= FILE_BYTES:
                        if out:
                            out.close()
                        names.append(f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                        out, size = io.BufferedWriter(files.open_output_stream(f"{root}/{names[-1]}", compression=None), 1 << 20), 0
                    record = record_bytes({c: v[i].as_py() for c, v in columns.items()})
                    data = member(record, self.level) if self.packed else record
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Archives(names)

    def commit(self, messages: list[Archives | None]) -> None:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        names = [n for m in messages if m for n in m.names]
        old = [f for f in files.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name not in names] if self.overwrite else []
        replaced = [f.base_name for f in old if f.base_name.startswith("_manifest-")]
        with files.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"archives": names, "replaces": replaced}).encode())
        # Archives first: while a replaced manifest is there, so is the one that replaces it.
        for f in sorted(old, key=lambda f: f.base_name in replaced):
            files.delete_file(f.path)

    def abort(self, messages: list[Archives | None]) -> None:
        files, root = filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            files.delete_file(f"{root}/{name}")


class WarcDataSource(ds.DataSource):
    """format("warc"). Options: path; compression gzip (default) or none; level 1-9. A schema of fewer columns
    leaves the others undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip") == "gzip", int(self.options.get("level", 6)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: Pages with one payload from which on its first page is told by a broadcast; there are at most rows / HOT such payloads.
HOT = 10_000


def page_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages as WARC rows: of equal payloads of at least least_bytes the smallest page id is a response and the
    others revisit it; all smaller payloads are responses.

    A null html is an empty payload; a null url leaves the field out. Repeated rows of the page that the others
    revisit are responses too. A page without an id revisits if another page with the same payload has one. An empty
    table gives no rows; columns other than the three named are ignored.

    Cost: an aggregation over digests. Payloads of HOT pages or more, such as empty and error pages, learn their first
    page by a broadcast of so few rows that it is checked; the others by one join on the digest, which carries each
    payload once.
    """
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), body.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    first = (
        rows.where(F.length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
    )
    first = written(first, "first")
    hot = first.where(F.col("n") >= HOT).select(F.col("digest").alias("hot_digest"), F.col("first").alias("hot_first"))

    def name(c: str):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    rows = rows.join(small(hot, n), rows["digest"] == hot["hot_digest"], "left") if (n := hot.count()) else rows.withColumn("hot_first", F.lit(None).cast("long"))
    # Rows that know their first page get a key of their own, which matches nothing and spreads them.
    key = F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.concat(F.unhex(F.hex(F.xxhash64("page_id", "target_uri"))), F.lit(b"hot")))
    cold = first.where(F.col("n") < HOT).select(F.col("digest").alias("cold_digest"), F.col("first").alias("cold_first"))
    joined = rows.withColumn("cold_key", key).join(cold, F.col("cold_key") == F.col("cold_digest"), "left")
    joined = joined.withColumn("first", F.coalesce("hot_first", "cold_first"))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        name("page_id").alias("record_id"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        "target_uri",
        F.when(revisit, name("first")).alias("refers_to"),
        "payload",
    )


def page_id_of(column: str):
    """The page id in a record's name; null for a page without one."""
    return F.nullif(F.regexp_extract(column, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, level: int = 6) -> None:
    """Archives of all pages at a path (see page_records); those already there stay."""
    register(pages.sparkSession)
    page_records(pages, least_bytes).write.format("warc").mode("append").option("level", level).save(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of archives, malformed ones as `records` says; with `columns`, only those are decoded. payload_bytes is
    the payload's own length, of a revisit the one that its HTTP header tells; digest_ok tells whether the payload has the
    digest that the WARC header gives, null where there is no payload or no digest. A path without archives gives no rows."""
    register(spark)
    reader = spark.read.format("warc").option("path", path)
    if columns:
        kinds = dict(x.split(" ", 1) for x in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load()
