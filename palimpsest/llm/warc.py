"""WARC archives as a PySpark Python data source.

Reading: partitions are planned from the files and, where a file has an index of offsets beside it,
from stretches of it.  Predicates on header fields are pushed down; headers are parsed first, and
the block of a record that is not wanted, or whose payload no column asks for, is skipped, not
decoded: in plain files stepped over, and in compressed ones too, where members say how long they
are, as those written here do.  Writing: each task writes files under names of its own, and only the manifest, written on
commit, makes them part of the archive; what a lost task has left behind is never read.

Options: path (a full URI, in a store that all executors reach; read_warc and archive_pages make one of any path), split_bytes (stretch of a file for one task),
index_bytes (between offsets of the index), compression (``gzip``: one member a record).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .batches import filesystem
from .shared import qualified, scratch, ship

#: Column: header field.
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
}
LONGS = {"payload_length", "content_length"}
SCHEMA = ", ".join(f"{c} {'long' if c in LONGS else 'string'}" for c in FIELDS) + ", payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
STRETCH = 32 << 20
INDEX_EVERY = 1 << 20
BATCH_BYTES = 8 << 20
READ_BYTES, HEADER_STEP = 256 << 10, 1 << 10
#: Extra field of a gzip header with the lengths of the member and of its content (skip-lengths of the WARC standard's annex).
SKIP_FIELD = b"sl"


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "WarcReader":
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> "WarcWriter":
        return WarcWriter(self.options, schema, overwrite)


def _listed(root: str) -> list[tuple[str, int]]:
    """Files of an archive and their sizes: those of its manifests, or else all that look like WARC."""
    fs, path = filesystem(root)
    infos = [fs.get_file_info(path)]
    if infos[0].type == pafs.FileType.Directory:
        infos = fs.get_file_info(pafs.FileSelector(path))
        manifests = [i for i in infos if i.base_name.startswith("_manifest-")]
        if manifests:
            names = set()
            for m in manifests:
                with fs.open_input_stream(m.path) as f:
                    names |= set(json.loads(f.read())["files"])
            infos = [i for i in infos if i.base_name in names]
    return sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path))


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.root, self.stretch = options["path"], int(options.get("split_bytes", STRETCH))
        self.columns = [(f.name, f.name in LONGS) for f in schema.fields]
        unknown = [c for c, _ in self.columns if c not in FIELDS and c != "payload"]
        if unknown:
            raise ValueError(f"a WARC record has no column {unknown[0]}")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in FIELDS and isinstance(f, EqualTo):
                self.tests.append((name, "in", {f.value}))
            elif name in FIELDS and isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif name in FIELDS and isinstance(f, IsNotNull):
                self.tests.append((name, "known", None))
            elif name in FIELDS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        out = []
        fs = filesystem(self.root)[0]
        for path, size in _listed(self.root):
            cuts = [0]
            if fs.get_file_info(path + ".offsets").type == pafs.FileType.File:
                with fs.open_input_stream(path + ".offsets") as f:
                    for offset in map(int, f.read().split()):
                        if offset - cuts[-1] >= self.stretch:
                            cuts.append(offset)
            out += [Stretch(path, a, b) for a, b in zip(cuts, [*cuts[1:], size])]
        return out or [Stretch("", 0, 0)]

    def read(self, part: Stretch):
        names = [c for c, _ in self.columns]
        kinds = [pa.binary() if c == "payload" else pa.int64() if is_long else pa.string() for c, is_long in self.columns]
        rows, held = [], 0
        for row in self._records(part) if part.path else ():
            rows.append(row)
            held += 200 + len(row.get("payload") or b"")
            if held >= BATCH_BYTES:
                yield self._batch(rows, names, kinds)
                rows, held = [], 0
        if rows:
            yield self._batch(rows, names, kinds)

    @staticmethod
    def _batch(rows, names, kinds):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names=names)

    def _records(self, part: Stretch):
        want = any(c == "payload" for c, _ in self.columns)
        fs = filesystem(self.root)[0]
        with fs.open_input_file(part.path) as f:
            source = _Gzip(f, part.start, part.end) if part.path.endswith(".gz") else _Plain(f, part.start, part.end)
            while (head := source.header()) is not None:
                fields = dict(re.findall(r"^([^:\r\n]+):[ \t]*(.*?)\r?$", head, re.M))
                fields = {k.lower(): v for k, v in fields.items()}
                length = int(fields["content-length"])
                row = {c: fields.get(h.lower()) for c, h in FIELDS.items()}
                for c in LONGS:
                    row[c] = None if row[c] is None else int(row[c])
                if not self._passes(row):
                    source.skip(length)
                    continue
                if want and row["record_type"] != "revisit":
                    block = source.block(length)
                    if "application/http" in (row["content_type"] or ""):
                        block = block[block.index(b"\r\n\r\n") + 4 :]
                    row["payload"] = block
                else:
                    source.skip(length)
                yield row

    def _passes(self, row: dict) -> bool:
        for name, how, value in self.tests:
            v = row[name]
            if v is None or how == "in" and v not in value or how == "starts" and not v.startswith(value):
                return False
        return True


class _Plain:
    """Records of an uncompressed file: blocks can be stepped over."""

    def __init__(self, f, start: int, end: int):
        self.f, self.at, self.end = f, start, end

    def header(self) -> str | None:
        if self.at >= self.end:
            return None
        head, step = b"", 1024
        while (i := head.find(b"\r\n\r\n")) < 0:
            more = self.f.read_at(step, self.at + len(head))
            if not more:
                raise ValueError("a WARC header has no end")
            head += more
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {self.at}")
        self.at += i + 4
        return head[:i].decode("utf-8", "replace")

    def block(self, length: int) -> bytes:
        out = self.f.read_at(length, self.at)
        if len(out) != length:
            raise ValueError("a WARC block is cut off")
        self.skip(length)
        return out

    def skip(self, length: int) -> None:
        self.at += length + 4


class _Gzip:
    """Records of a file with one gzip member each.

    Only the header is inflated to begin with.  What a caller skips is stepped over where the member
    says how long it is (``SKIP_FIELD``), and is inflated without being kept where it doesn't.
    """

    def __init__(self, f, start: int, end: int):
        self.f, self.at, self.end = f, start, end
        self.held, self.base = b"", start
        self.inflated = 0  # bytes, in all

    def _bytes(self, at: int, n: int) -> bytes:
        if at < self.base or at + n > self.base + len(self.held):
            self.held, self.base = self.f.read_at(min(max(n, READ_BYTES), self.end - at), at), at
        return self.held[at - self.base : at - self.base + n]

    def _more(self, most: int) -> bytes:
        data = self.d.unconsumed_tail
        if not data and not self.d.eof:
            data = self._bytes(self.fed, min((self.next or self.end) - self.fed, 16 << 10))
            self.fed += len(data)
            if not data:
                raise ValueError("a gzip member is cut off")
        out = self.d.decompress(data, most)
        self.inflated += len(out)
        return out

    def header(self) -> str | None:
        if self.at >= self.end:
            return None
        self.d, self.fed, self.next = zlib.decompressobj(31), self.at, None
        if (size := member_size(self._bytes(self.at, min(26, self.end - self.at)))) is not None:
            self.next = self.at + size
        head = b""
        while (i := head.find(b"\r\n\r\n")) < 0:
            if self.d.eof:
                raise ValueError("a WARC header has no end")
            head += self._more(HEADER_STEP)
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {self.at}")
        self.rest = head[i + 4 :]
        return head[:i].decode("utf-8", "replace")

    def block(self, length: int) -> bytes:
        out, size = [self.rest], len(self.rest)
        while size < length and not self.d.eof:
            out.append(self._more(length - size))
            size += len(out[-1])
        if size < length:
            raise ValueError("a WARC block is cut off")
        self.skip(length)
        return b"".join(out)[:length]

    def skip(self, length: int) -> None:
        if self.next is None:
            while not self.d.eof:
                self._more(1 << 20)
            self.next = self.fed - len(self.d.unused_data)
        self.at = self.next


def member(raw: bytes) -> bytes:
    """A gzip member that says in its header how long it and its content are (not if that is beyond 4 bytes)."""
    c = zlib.compressobj(wbits=-15)
    body = c.compress(raw) + c.flush()
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    whole = 12 + 12 + len(body) + 8
    if whole < 1 << 32 and len(raw) < 1 << 32:
        return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, SKIP_FIELD, 8, whole, len(raw)) + body + tail
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail


def member_size(head: bytes) -> int | None:
    """Bytes of the whole gzip member that begins with these 26 bytes, if its first extra field says so."""
    if len(head) < 24 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4 or head[12:16] != SKIP_FIELD + b"\x08\0":
        return None
    return struct.unpack("<I", head[16:20])[0]


class WarcWriter(DataSourceWriter):
    """Takes the columns of SCHEMA, or some of them; content_length and content_type are made here."""

    def __init__(self, options, schema, overwrite: bool):
        self.root, self.gzip, self.overwrite = options["path"], options.get("compression") == "gzip", overwrite
        self.every = int(options.get("index_bytes", INDEX_EVERY))

    def write(self, rows) -> Written:
        fs, root = filesystem(self.root)
        fs.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        at, offsets, sink = 0, [], None
        for row in rows:
            if sink is None:
                sink = fs.open_output_stream(f"{root}/{name}", compression=None)  # else .gz would be compressed again
            if not offsets or at - offsets[-1] >= self.every:
                offsets.append(at)
            raw = record(row.asDict())
            if self.gzip:
                raw = member(raw)
            sink.write(raw)
            at += len(raw)
        if sink is None:
            return Written([])
        sink.close()
        with fs.open_output_stream(f"{root}/{name}.offsets") as f:
            f.write("\n".join(map(str, offsets)).encode())
        return Written([name])

    def commit(self, messages) -> None:
        fs, root = filesystem(self.root)
        fs.create_dir(root, recursive=True)
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.startswith("_manifest-")]
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}") as f:
            f.write(json.dumps({"files": [x for m in messages if m for x in m.files]}).encode())
        for path in old if self.overwrite else ():
            fs.delete_file(path)

    def abort(self, messages) -> None:
        fs, root = filesystem(self.root)
        for name in (x for m in messages if m for x in m.files):
            fs.delete_file(f"{root}/{name}")


def record(row: dict) -> bytes:
    """Bytes of one record: WARC header, HTTP header and (but for revisits) payload."""
    payload = b"" if row.get("payload") is None else bytes(row["payload"])
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (row.get("payload_length") if row.get("payload_length") is not None else len(payload))
    block = http if row["record_type"] == "revisit" else http + payload
    row = row | {"content_type": "application/http;msgtype=response", "content_length": len(block)}
    lines = ["WARC/1.0"] + [f"{h}: {re.sub(r'[\r\n]+', ' ', str(row[c]))}" for c, h in FIELDS.items() if row.get(c) is not None]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of an archive; only ``columns`` are made (all by default), and without ``payload`` no block is read."""
    register(spark)
    r = spark.read.format("warc").option("path", qualified(spark, path))
    if columns:
        r = r.schema(", ".join(f"{c} {'binary' if c == 'payload' else 'long' if c in LONGS else 'string'}" for c in columns))
    return r.load()


#: Shorter payloads are never replaced by a revisit.
LEAST = 100


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record for each page: of pages with equal payloads the one with the smallest id is the response, others revisit it.

    A null html is an empty payload; a null url gives no target.  A page with a null id is always a
    response.  Of rows that share the smallest id all are responses.  The join is between pages and
    those payload digests that occur more than once; Spark splits a hot digest.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    again = p.filter(F.col("payload_length") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    p = p.join(again.select("digest", "first"), "digest", "left")
    revisit = F.coalesce((F.col("page_id") > F.col("first")) & (F.col("payload_length") >= least), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return p.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"), F.lit(date).alias("date"), "target_uri",
        F.when(revisit, urn(F.col("first"))).alias("refers_to"), F.when(revisit, F.lit(REVISIT_PROFILE)).alias("profile"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"), "payload_length", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, out: str | None = None, compression: str = "gzip", **options) -> DataFrame:
    """Write an archive (a gzip member each record, or plain with ``compression="none"``), read it back: (page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of every record.

    Length and digest of a response are those of the payload that was read; a revisit has them in its header.
    """
    spark = pages.sparkSession
    register(spark)
    out = qualified(spark, out or scratch(spark, "warc"))
    page_records(pages, **options).write.format("warc").mode("append").option("path", out).option("compression", compression).save()
    # Responses are read with their payloads; of revisits, whose payloads are elsewhere, only headers are.
    columns = ["record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_length"]
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+|null)>$", 1).try_cast("long")
    shared = lambda payload_bytes, digest: [page("record_id").alias("page_id"), payload_bytes.alias("payload_bytes"), digest.alias("payload_digest"), F.col("record_type"), page("refers_to").alias("refers_to"), F.col("target_uri")]
    full = read_warc(spark, out, [*columns, "payload"]).filter("record_type = 'response'")
    again = read_warc(spark, out, columns).filter("record_type = 'revisit'")
    full = full.select(*shared(F.octet_length("payload").cast("long"), F.sha2("payload", 256)))
    return full.unionByName(again.select(*shared(F.col("payload_length"), F.regexp_replace("payload_digest", "^sha256:", ""))))
