"""A plain SQL dump (statements, and COPY sections of tab-separated rows) as a source and a sink.

A dump is a file or a folder of files. Tasks look through byte ranges of the files for the lines that can open or end a
section; only these lines reach the driver, which tells sections from rows that look alike (inside a section nothing but
its end counts, and no row can be an end, as its backslash would be doubled). The data source `sqldump` then has a partition
for each range of a section of the wanted table: other tables are never read, unwanted columns never decoded, and rows that
fail a pushed comparison are left after their raw field was looked at.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: Bytes of a range, and rows of a batch.
SPLIT, ROWS = 1 << 26, 1000
#: The escapes of the COPY text format, and its mark of a null.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
NULL, END = rb"\N", b"\\."
#: Column types of dumps that are read as other types than string.
TYPES = {"bigint": "long", "integer": "int", "smallint": "short", "double precision": "double", "real": "float", "boolean": "boolean", "bytea": "binary", "vector": "array<float>"}

_ESCAPE = re.compile(r"\\([0-7]{1,3}|x[0-9A-Fa-f]{1,2}|.)", re.DOTALL)
_COPY = re.compile(r'^COPY (\S+) \((.*)\) FROM stdin;\s*$')


def unescaped(field: bytes) -> str | None:
    """The text of a raw field; a null for its mark."""
    if field == NULL:
        return None
    if b"\\" not in field:
        return field.decode()
    if not re.search(rb"\\(?:[0-7]|x[0-9A-Fa-f])", field):
        return _ESCAPE.sub(lambda m: ESCAPES.get(m[1], m[1]), field.decode())

    def raw(m: re.Match) -> bytes:  # octal and hexadecimal escapes are bytes of the text's encoding
        e = m[1].decode("latin-1")
        if e[0] in "01234567":
            return bytes([int(e, 8) & 255])
        if e[0] == "x" and len(e) > 1:
            return bytes([int(e[1:], 16)])
        return ESCAPES.get(e, e).encode("latin-1")

    return re.sub(rb"\\([0-7]{1,3}|x[0-9A-Fa-f]{1,2}|.)", raw, field, flags=re.DOTALL).decode()


def escaped(column) -> F.Column:
    """A value as a field of a section."""
    out = F.replace(column.cast("string"), F.lit("\\"), F.lit("\\\\"))
    for letter, char in ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return F.coalesce(out, F.lit(r"\N"))


def write_dump(rows: DataFrame, folder: str, table: str, types: dict[str, str]) -> None:
    """Add rows to the dump in folder, a section a file; types are the columns' types in the dump."""
    quoted = ", ".join(f'"{c}"' for c in types)
    line = rows.select(F.concat_ws("\t", *[escaped(F.col(f"`{c}`")) for c in types]).alias("value"))
    create = [f"CREATE TABLE {table} (", *[f'    "{c}" {t}' + "," * (k < len(types) - 1) for k, (c, t) in enumerate(types.items())], ");"]

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = lambda lines: pa.RecordBatch.from_pydict({"value": lines})
        yield block([*create, f"COPY {table} ({quoted}) FROM stdin;"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])
        yield block([END.decode()])

    line.mapInArrow(framed, "value string").write.mode("append").text(folder)


def open_file(path: str):
    """A file for random reading, on the file system of its URI."""
    from pyarrow import fs

    path = re.sub(r"^s3[an]:", "s3:", path)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def lines_of(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of the lines that begin in [start, end)."""
    at = start
    if start:
        file.seek(start - 1)
        at = start - 1 + len(file.readline())
    else:
        file.seek(0)
    while at < end and (line := file.readline()):
        yield at, line.rstrip(b"\r\n")
        at += len(line)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found: list[tuple[str, int, int, str]] = []
            with open_file(path) as file:
                reader = io.BufferedReader(_raw(file), 1 << 20)
                for at, line in lines_of(reader, start, end):
                    if line == END or line.startswith((b"COPY ", b"CREATE TABLE ")):
                        if line.startswith(b"CREATE TABLE "):
                            back = reader.tell()
                            while not line.endswith(b");") and (more := reader.readline()):
                                line += more.rstrip(b"\r\n")
                            reader.seek(back)
                        found.append((path, at, at + len(line) + 1, line.decode(errors="replace")))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else ([],) * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "at", "after", "line"])


def _raw(file):
    """An Arrow file as Python's raw reader, for fast reading of lines."""

    class Raw(io.RawIOBase):
        def readable(self):
            return True

        def seekable(self):
            return True

        def readinto(self, buffer):
            got = file.read(len(buffer))
            buffer[: len(got)] = got
            return len(got)

        def seek(self, at, whence=0):
            return file.seek(at, whence)

        def tell(self):
            return file.tell()

    return Raw()


@dataclass(frozen=True)
class Section:
    path: str
    table: str
    columns: tuple[str, ...]
    start: int
    end: int


def sections(spark: SparkSession, path: str, split: int = SPLIT) -> tuple[list[Section], dict[str, dict[str, str]]]:
    """The sections of a dump, and the columns' types of each table that it makes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length"), F.lit(split).cast("long"))).alias("start")).withColumn("end", F.col("start") + split)
    marks = ranges.repartition(F.col("path"), F.col("start")).mapInArrow(_marks, "path string, at long, after long, line string")
    out, made, now = [], {}, None
    for m in sorted(marks.collect(), key=lambda m: (m["path"], m["at"])):
        if now is not None and m["path"] != now[0]:
            now = None
        if now is None and (copy := _COPY.match(m["line"])):
            now = (m["path"], copy[1], tuple(c.strip().strip('"') for c in copy[2].split(",")), m["after"])
        elif now is not None and m["line"] == END.decode():
            out.append(Section(*now, m["at"]))
            now = None
        elif now is None and (create := re.match(r"^CREATE TABLE (\S+) \((.*)\);$", m["line"])):
            columns = (re.match(r'\s*"?(\w+)"?\s+(.+?)(?:\s+NOT NULL|\s+DEFAULT.*)?\s*$', c) for c in re.split(r",(?![^(]*\))", create[2]))
            made[create[1]] = {c[1]: c[2] for c in columns if c and c[1] != "CONSTRAINT"}
    return out, made


def spark_type(of: str) -> str:
    base = re.sub(r"\(.*\)", "", of).strip().lower()
    if base == "numeric" and (size := re.search(r"\((\d+),\s*(\d+)\)", of)):
        return f"decimal({size[1]},{size[2]})"
    return "timestamp_ntz" if base.startswith("timestamp") else TYPES.get(base, "string")


@dataclass(frozen=True)
class DumpRange(InputPartition):
    path: str
    columns: tuple[str, ...]
    start: int
    end: int


class _DumpReader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.names, self.kinds = schema.fieldNames(), [f.dataType.simpleString() for f in schema.fields]
        self.sections, self.split = [Section(s[0], s[1], tuple(s[2]), s[3], s[4]) for s in json.loads(options["sections"])], int(options["split"])
        self.wanted: list[tuple[str, frozenset[bytes]]] = []

    def pushFilters(self, filters):
        for f in filters:
            kind = self.kinds[self.names.index(f.attribute[0])] if len(f.attribute) == 1 and f.attribute[0] in self.names else None
            values = f.value if isinstance(f, In) else [f.value] if isinstance(f, EqualTo) else []
            plain = all(v is not None and not set("\\\t\n\r\b\f\v") & set(str(v)) for v in values)
            # whole numbers have one spelling, and so have texts without characters that are escaped
            if values and plain and kind in ("bigint", "int", "smallint", "string"):
                self.wanted.append((f.attribute[0], frozenset(str(v).encode() for v in values)))
            # Spark filters again, as other writers may escape more than they must
            yield f

    def partitions(self):
        return [DumpRange(s.path, s.columns, at, min(at + self.split, s.end)) for s in self.sections for at in range(s.start, s.end, self.split)] or [DumpRange("", (), 0, 0)]

    def read(self, part):
        if not part.path:
            return
        at = [part.columns.index(n) if n in part.columns else None for n in self.names]
        # a field with an escape may spell a wanted value in another way
        rules = [(part.columns.index(n), values) for n, values in self.wanted if n in part.columns]
        rows: list[list] = []
        with open_file(part.path) as file:
            for _, line in lines_of(io.BufferedReader(_raw(file), 1 << 20), part.start, part.end):
                fields = line.split(b"\t")
                if all(fields[i] in values or b"\\" in fields[i] for i, values in rules):
                    rows.append([None if i is None else _value(unescaped(fields[i]), kind) for i, kind in zip(at, self.kinds, strict=True)])
                if len(rows) == ROWS:
                    yield from (tuple(r) for r in rows)
                    rows = []
        yield from (tuple(r) for r in rows)


def _value(text: str | None, kind: str):
    if text is None or kind == "string":
        return text
    if kind in ("bigint", "int", "smallint"):
        return int(text)
    if kind in ("double", "float"):
        return float(text)
    if kind == "boolean":
        return text == "t"
    if kind == "binary":
        return bytes.fromhex(text[2:])
    if kind == "array<float>":
        return [float(x) for x in text.strip("[]").split(",")] if text != "[]" else []
    if kind == "timestamp_ntz":
        from datetime import datetime

        return datetime.fromisoformat(text)
    from decimal import Decimal

    return Decimal(text)


class SqlDump(DataSource):
    """Options: sections (as JSON, of one table), split; the schema is given."""

    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return _DumpReader(schema, self.options)


def read_dump(spark: SparkSession, path: str, table: str, columns: tuple[str, ...] | None = None, split: int = SPLIT) -> DataFrame:
    """The rows of a table of the dump; columns it does not make, or all if it makes none, are strings."""
    found, made = sections(spark, path, split)
    own = [s for s in found if s.table == table]
    types = made.get(table, {})
    names = columns or tuple(types) or (own[0].columns if own else ())
    if not names:
        raise ValueError(f"the dump has no table {table}")
    spark.dataSource.register(SqlDump)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    said = json.dumps([[s.path, s.table, s.columns, s.start, s.end] for s in own])
    ddl = ", ".join(f"`{n}` {spark_type(types.get(n, 'text'))}" for n in names)
    return spark.read.format("sqldump").option("sections", said).option("split", split).option("columns", ddl).load()
