"""Operator 3, WARC archives as a Python data source, `trawl_warc`.

Writing: one file a task under a unique name, each record its own gzip member whose extra field `sl` holds the compressed
and uncompressed length; committing a job adds a manifest of the files of the attempts that won, with offsets to split
at, so files of lost or repeated attempts are never read. Reading: a partition is a file, or a span between split
offsets. Filters on record_type and header columns are pushed down; a record's headers are inflated first, and the
payload of a record that fails them, or that nobody asked for (option payload=false), is skipped by the `sl` length
without being inflated. Archives of other writers (plain .warc, or gzip without `sl`) are read too, a file a partition.

Records with equal payloads: `with_revisits` makes the one with the largest page_id the response and the others of at
least MIN_REVISIT bytes revisits of it. Groups are pre-aggregated by digest and joined back with salts for hot ones.

Defined cases: a null html is the empty payload; a null url is written as no target; records whose page_id is null are
responses of their own; rows that repeat page_id and payload of the largest id are all responses; other columns are
ignored; an empty table writes no record and reads as an empty result.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from trawl.llm.shared import bounded_batches, open_fs, salted_join
from trawl.scratch import fresh_path, hand_out, materialise

MIN_REVISIT = 1000
SPLIT_BYTES = 16 << 20
LEVEL = 3
#: Fixed values of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_SPACE = 0x7472_6177_6C00_4000 << 64
SCHEMA = "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_PUSHED = ("page_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to")


def record_uri(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=ID_SPACE | page_id & (1 << 64) - 1)}>"


def id_of(uri: str | None) -> int | None:
    """The page id inside a record URI of ours; null for others."""
    if not uri or not uri.startswith("<urn:uuid:"):
        return None
    number = uuid.UUID(uri[10:-1]).int
    if number >> 64 != ID_SPACE >> 64:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record_bytes(page_id: int | None, kind: str, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC 1.1 record; a revisit carries the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines.append(f"WARC-Record-ID: {record_uri(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose extra field `sl` has the lengths of the whole member and of the data."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_head(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


class _Gzip:
    """Members of a gzip file: headers first, the rest only if asked for."""

    def __init__(self, file, at: int, end: int) -> None:
        self.file, self.at, self.end = file, at, end

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        while self.at < self.end:
            self.file.seek(self.at)
            data = self.file.read(32 << 10)
            if len(data) < 18:
                return
            known = struct.unpack("<I", data[16:20])[0] if data[3] & 4 and data[12:14] == b"sl" else 0
            unzip = zlib.decompressobj(31)
            text = unzip.decompress(data, 4096)
            while b"\r\n\r\n" not in text:
                more = unzip.unconsumed_tail or self.file.read(32 << 10)
                if not more:
                    return
                text += unzip.decompress(more, 4096)
            head, _, start = text.partition(b"\r\n\r\n")
            headers = parse_head(head)
            take = wanted(headers)
            if known and take is not True:
                self.at += known
            else:
                parts, tail = [start], unzip.unconsumed_tail
                while not unzip.eof:
                    more = tail or self.file.read(256 << 10)
                    if not more:
                        break
                    part, tail = unzip.decompress(more, 1 << 20), unzip.unconsumed_tail
                    if take is True:
                        parts.append(part)
                self.at = self.file.tell() - len(unzip.unused_data) if unzip.eof else self.end
                start = b"".join(parts)
            if take is not None:
                yield headers, start[: int(headers.get("content-length", 0))] if take is True else None


class _Plain:
    """Records of an uncompressed file; unwanted blocks are skipped by their Content-Length."""

    def __init__(self, file, at: int, end: int) -> None:
        self.file, self.at, self.end = file, at, end

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        while self.at < self.end:
            self.file.seek(self.at)
            text = b""
            while b"\r\n\r\n" not in text:
                more = self.file.read(4096)
                if not more:
                    return
                text += more
            head, _, _ = text.partition(b"\r\n\r\n")
            headers, body = parse_head(head), self.at + len(head) + 4
            size = int(headers.get("content-length", 0))
            take = wanted(headers)
            self.at = body + size + 4
            if take is True:
                self.file.seek(body)
                yield headers, self.file.read(size)
            elif take is False:
                yield headers, None


def header_values(headers: dict[str, str]) -> dict[str, object]:
    digest = headers.get("warc-payload-digest", "")
    size = headers.get("x-payload-length")
    return {
        "page_id": id_of(headers.get("warc-record-id")),
        "record_type": headers.get("warc-type"),
        "target_uri": headers.get("warc-target-uri"),
        "payload_digest": digest.removeprefix("sha1:") or None,
        "payload_bytes": int(size) if size else None,
        "refers_to": id_of(headers.get("warc-refers-to")),
    }


class WarcPart(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.rules: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.rules.append((f.attribute[0], frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, path = open_fs(self.path)
        info = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = {x.base_name: x for x in info if x.is_file}
        manifests = [n for n in names if n.startswith("_manifest-")]
        parts = []
        if manifests:
            for name in manifests:
                with system.open_input_stream(f"{path}/{name}") as f:
                    for file in json.loads(f.read()):
                        edges = [*file["splits"], file["bytes"]]
                        parts += [WarcPart(f"{self.path}/{file['name']}", a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
        else:
            parts = [WarcPart(f"{self.path}/{n}", 0, x.size) for n, x in sorted(names.items()) if n.endswith((".warc", ".warc.gz"))]
        return parts or [WarcPart("", 0, 0)]

    def read(self, part: WarcPart) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        rules, payload = self.rules, self.payload
        values: dict[str, object] = {}

        def wanted(headers: dict[str, str]) -> bool | None:
            """None: not this record; False: its headers only; True: its payload too."""
            nonlocal values
            if headers.get("warc-type") not in ("response", "revisit"):
                return None
            values = header_values(headers)
            if any(values[k] not in allowed for k, allowed in rules):
                return None
            return payload and values["record_type"] == "response"

        rows: list[dict] = []
        size = 0
        system, path = open_fs(part.path)
        with system.open_input_file(path) as file:
            kind = _Gzip if path.endswith(".gz") else _Plain
            for _, block in kind(file, part.start, part.end).records(wanted):
                body = block.partition(b"\r\n\r\n")[2] if block is not None else None
                rows.append(values | {"payload": body})
                size += len(body or b"") + 300
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcCommit(WriterCommitMessage):
    def __init__(self, name: str, size: int, splits: list[int]) -> None:
        self.name, self.size, self.splits = name, size, splits


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.level = options["path"], int(options.get("level", LEVEL))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WarcCommit:
        system, path = open_fs(self.path)
        system.create_dir(path, recursive=True)
        name, at, splits = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            info = gzip_member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:" + str(uuid.uuid4()).encode() + b">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n", self.level)
            out.write(info)
            at += len(info)
            for batch in batches:
                columns = [batch.column(k) for k in ("page_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload")]
                for row in zip(*columns, strict=True):
                    page_id, kind, url, digest, size, refers, payload = (x.as_py() for x in row)
                    member = gzip_member(record_bytes(page_id, kind, url, digest, size, refers, payload or b""), self.level)
                    if at - splits[-1] >= SPLIT_BYTES:
                        splits.append(at)
                    out.write(member)
                    at += len(member)
        return WarcCommit(name, at, splits)

    def commit(self, messages: list[WarcCommit | None]) -> None:
        system, path = open_fs(self.path)
        system.create_dir(path, recursive=True)
        done = [{"name": m.name, "bytes": m.size, "splits": m.splits} for m in messages if m is not None]
        with system.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(done).encode())

    def abort(self, messages: list[WarcCommit | None]) -> None:
        system, path = open_fs(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{path}/{m.name}")


class WarcSource(DataSource):
    """spark.read.format("trawl_warc").load(dir); write with mode append."""

    @classmethod
    def name(cls) -> str:
        return "trawl_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    bounded_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """The columns of SCHEMA for each row of pages (page_id, url, html)."""
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), body.alias("payload"))
    rows = rows.select("page_id", "target_uri", F.sha1("payload").alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"), "payload")
    large = rows.filter(F.col("payload_bytes") >= min_bytes).withColumn("_key", F.struct("payload_digest", "payload_bytes"))
    # only copies meet: small payloads are responses as they are, and a payload with very many copies is dealt over tasks
    groups = materialise(large.groupBy("_key").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "payloads")
    joined = salted_join(large, groups.drop("n"), "_key", "left", counts=groups.select("_key", "n")).drop("_key")
    joined = joined.unionByName(rows.filter(F.col("payload_bytes") < min_bytes).withColumn("_first", F.lit(None).cast("long")))
    again = F.coalesce(F.col("page_id") < F.col("_first"), F.lit(False))
    return joined.select(
        "page_id", F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload_digest", "payload_bytes",
        F.when(again, F.col("_first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT) -> None:
    """Archive pages under path."""
    register(pages.sparkSession)
    with_revisits(pages, min_bytes).write.format("trawl_warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under path, of types response and revisit."""
    register(spark)
    return spark.read.format("trawl_warc").option("payload", str(payload).lower()).load(path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back; of responses length and digest are taken from the payload as read."""
    path = hand_out(spark, fresh_path(spark, "warc"))
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = read(spark, path)
    own = F.col("payload").isNotNull()
    return back.select(
        "page_id", F.when(own, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages
), q AS (
  SELECT page_id, n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM q
"""
