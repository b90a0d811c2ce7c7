"""WARC archives as a PySpark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: rows (page_id, url, payload, refers_to, is_revisit) become gzip
members of one record each, in files rolled at ``file_bytes``. A row with
``refers_to`` is a revisit and stores the HTTP header only. Each task writes
under temporary names and renames its files when it ends, so a repeated task
replaces its own files.

Reading: one input partition holds whole files of about ``split_bytes``. Equality,
membership and prefix predicates on header columns (``record_type`` first of
all) are pushed down: a record's header is inflated and tested before anything
else, and an unwanted record is skipped by the length in its gzip header, so its
payload is never read. A schema without ``payload`` skips the payloads of wanted
records too, unless ``verify`` is set: then length and SHA-1 of each response
are checked against its header. Plain files and members without a stored length
are read as well.

Null payloads are empty, null urls have no target URI. A null page id is the
smallest, equal page ids are told apart by nothing, so all rows with the largest
page id of a payload are responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

SCHEMA = ("record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
          "payload_length long, content_type string, content_length long, payload binary")
#: Column -> header field.
HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to",
          "payload_digest": "warc-payload-digest", "payload_length": "warc-x-payload-length", "content_type": "content-type", "content_length": "content-length"}
DATE = "1970-01-01T00:00:00Z"
PAGE = "urn:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str):
    """The store of a path or URI, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records -----------------------------------------------------------------------------
def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member that carries its own length in an extra field, so that a reader can step over it."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 12 + 8 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHI", 8, b"SL", 4, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def page_record(page_id, url, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    fields = {"WARC-Type": "revisit" if is_revisit else "response", "WARC-Record-ID": f"<{PAGE}{page_id}>", "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")
    if is_revisit:
        fields |= {"WARC-Refers-To": f"<{PAGE}{refers_to}>", "WARC-Profile": REVISIT}
    fields |= {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-X-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(fields, http if is_revisit else http + payload)


def parse_header(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


class Members:
    """Records of a file, one after the other: their header first, their block only on request."""

    CHUNK = 1 << 14

    def __init__(self, f):
        self.f, self.at, self.size = f, 0, f.size()

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def __iter__(self) -> Iterator[tuple[dict[str, str], callable]]:
        while self.at < self.size:
            first = self._read(self.at, self.CHUNK)
            if first[:2] == b"\x1f\x8b":
                yield self._gzip(first)
            elif not first.strip():
                self.at += len(first)
            else:
                gap = len(first) - len(first.lstrip(b"\r\n"))
                yield self._plain(first[gap:], self.at + gap)

    def _plain(self, data: bytes, at: int):
        start = at
        while b"\r\n\r\n" not in data:
            more = self._read(at + len(data), self.CHUNK)
            if not more:
                raise ValueError("header without end")
            data += more
        end = data.index(b"\r\n\r\n")
        head = parse_header(data[:end])
        n = int(head.get("content-length", 0))
        self.at = start + end + 4 + n + 4
        return head, lambda: self._read(start + end + 4, n)

    def _gzip(self, data: bytes):
        start, length = self.at, None
        if data[3] & 4:
            extra = data[12:12 + struct.unpack("<H", data[10:12])[0]]
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"SL" and n == 4:
                    length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n:]
        d, out, pos = zlib.decompressobj(31), b"", start
        chunk = data if length is None else data[:length]
        while b"\r\n\r\n" not in out:
            if not chunk:
                raise ValueError("header without end")
            out += d.decompress(chunk, 2048)
            pos, chunk = (pos, d.unconsumed_tail) if d.unconsumed_tail else (pos + self.CHUNK, self._read(pos + self.CHUNK, self.CHUNK))
        end = out.index(b"\r\n\r\n")
        head = parse_header(out[:end])
        n = int(head.get("content-length", 0))

        def rest() -> bytes:
            if length is not None:
                whole = zlib.decompress(self._read(start, length), 31)
            else:
                whole = self._inflate(start)[0]
            return whole[end + 4:end + 4 + n]
        self.at = start + (length if length is not None else self._inflate(start)[1])
        return head, rest

    def _inflate(self, start: int) -> tuple[bytes, int]:
        d, out, pos = zlib.decompressobj(31), [], start
        while not d.eof:
            chunk = self._read(pos, 1 << 20)
            if not chunk:
                raise ValueError("member without end")
            out.append(d.decompress(chunk))
            pos += len(chunk)
        return b"".join(out), pos - len(d.unused_data) - start


# ---- reader ------------------------------------------------------------------------------
@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.names = options["path"], schema.names
        self.split, self.verify = int(options.get("split_bytes", 64 << 20)), str(options.get("verify", "false")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            col = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if col in HEADER and isinstance(f, EqualTo) and isinstance(f.value, (str, int)):
                self.tests.append((col, "in", (f.value,)))
            elif col in HEADER and isinstance(f, In):
                self.tests.append((col, "in", tuple(v for v in f.value if v is not None)))
            elif col in HEADER and isinstance(f, StringStartsWith):
                self.tests.append((col, "prefix", f.value))
            elif col in HEADER and isinstance(f, IsNotNull):
                self.tests.append((col, "known", None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs
        store, at = filesystem(self.path)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if store.get_file_info(at).type == fs.FileType.Directory else [store.get_file_info(at)]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")) and f.base_name[0] not in "._")
        out, part, size = [], [], 0
        for p, n in files:
            if part and size + n > self.split:
                out.append(Files(part))
                part, size = [], 0
            part, size = [*part, p], size + n
        return [*out, Files(part)]  # an empty folder is one partition without files

    @staticmethod
    def values(head: dict[str, str]) -> dict:
        got = {c: head.get(h) for c, h in HEADER.items()}
        for c in ("record_id", "refers_to"):
            got[c] = got[c].strip("<>") if got[c] else got[c]
        for c in ("payload_length", "content_length"):
            got[c] = int(got[c]) if got[c] and got[c].isdigit() else None
        got["payload_digest"] = got["payload_digest"].partition(":")[2] or got["payload_digest"] if got["payload_digest"] else None
        return got

    def wanted(self, got: dict) -> bool:
        return all(got[c] is not None and (how == "known" or got[c] in v if how != "prefix" else got[c].startswith(v)) for c, how, v in self.tests)

    def read(self, partition):
        store, _ = filesystem(self.path)
        whole = "payload" in self.names
        for path in partition.paths:
            with store.open_input_file(path) as f:
                for head, rest in Members(f):
                    got = self.values(head)
                    if self.tests and not self.wanted(got):
                        continue
                    got["payload"] = None
                    if whole or self.verify:
                        block = rest()
                        got["payload"] = block.partition(b"\r\n\r\n")[2] if (got["content_type"] or "").startswith("application/http") else block
                        if self.verify and got["record_type"] == "response" and (digest(got["payload"]) != got["payload_digest"] or len(got["payload"]) != got["payload_length"]):
                            raise ValueError(f"{path}: payload of {got['record_id']} does not match its header")
                    yield tuple(got[n] for n in self.names)


# ---- writer ------------------------------------------------------------------------------
@dataclass
class Written(WriterCommitMessage):
    files: int
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        if overwrite:
            raise ValueError("archives are written to a new folder, mode append")
        self.path, self.limit, self.level = options["path"], int(options.get("file_bytes", 64 << 20)), int(options.get("level", 6))

    def write(self, iterator):
        from pyspark import TaskContext
        store, at = filesystem(self.path)
        store.create_dir(at, recursive=True)
        task, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        names, records, out = [], 0, None
        info = member(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(int=task)}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"), self.level)
        for batch in iterator:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if out is None:
                    names.append((f"{at}/_{mark}-{len(names)}", f"{at}/part-{task:05d}-{len(names):04d}.warc.gz"))
                    out, size = store.open_output_stream(names[-1][0]), len(info)
                    out.write(info)
                row = {n: c[i].as_py() for n, c in col.items()}
                payload = row["payload"] or b""
                data = member(page_record(row["page_id"], row["url"], payload, row["refers_to"], row["is_revisit"]), self.level)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= self.limit:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        for a, b in names:
            store.move(a, b)
        return Written(len(names), records)

    def commit(self, messages):
        store, at = filesystem(self.path)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/_SUCCESS") as f:
            f.write(b"")

    def abort(self, messages):
        pass  # temporary names are never read


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- operators ---------------------------------------------------------------------------
def mark_revisits(pages: DataFrame, key: str = "page_id", payload: str = "payload", min_bytes: int = 0) -> DataFrame:
    """Add ``is_revisit`` and ``refers_to``: of equal payloads of at least ``min_bytes`` the row with the largest key stays a response.

    Payloads meet by SHA-256 and length; only those two and the largest key are grouped, with a partial maximum before
    the shuffle, and a payload that many rows share is joined to its one row.
    """
    mark = F.sha2(F.col(payload), 256)
    pages = pages.withColumn("__same", mark).withColumn("__n", F.octet_length(payload))
    top = pages.filter(F.col("__n") >= min_bytes).groupBy("__same", "__n").agg(F.max(key).alias("refers_to"))
    out = pages.drop("refers_to").join(top, ["__same", "__n"], "left")
    revisit = F.coalesce(F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col(key)), F.lit(False))
    return out.withColumn("is_revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("refers_to"))).drop("__same", "__n")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store, which Spark knows and a reader in Python has to be told."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Write rows (page_id, url, payload, refers_to, is_revisit) as archives into the new folder ``path``."""
    register(pages.sparkSession)
    pages.select("page_id", "url", "payload", "refers_to", "is_revisit").write.format("warc").options(**options).mode("append").save(qualified(pages.sparkSession, path))


def read_archives(spark: SparkSession, path: str, schema: str = SCHEMA, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).options(**options).load(qualified(spark, path))
