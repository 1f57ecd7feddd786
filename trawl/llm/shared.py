"""What the operators share: salted joins, Arrow and small numpy helpers. Written tables are of trawl.scratch."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.scratch import bounded_batches, materialise  # noqa: F401  the operators have it from here


def open_fs(path: str):
    """(file system, path) for a URI, as Spark writes it, or a local path."""
    from pyarrow import fs

    path = re.sub(r"^s3[an]:", "s3:", path)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


#: A key with more than a thousandth of all rows, and more than LEAST_HOT rows, is dealt over SALTS tasks.
HOT_PARTS, LEAST_HOT, SALTS = 1000, 1000, 32


def salted_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """many joined by sort-merge with one (at most a row a key) on key, where a key may hold a large part of many.

    counts (key, n) are many's rows by key; without it they are counted, so many should be a written table. The rows of one
    that belong to hot keys, HOT_PARTS at most, are copied SALTS times and many's are dealt over the copies by a hash of the row, which a repeated task finds again.
    """
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > max(total / HOT_PARTS, LEAST_HOT)).select(F.col(key).alias("_hot_key"))
    found = [r[0] for r in hot.limit(HOT_PARTS).collect()]
    if not found:
        return many.join(one.hint("merge"), key, how)
    known = F.broadcast(many.sparkSession.createDataFrame([(k,) for k in found], hot.schema))
    dealt = many.join(known, many[key] == known["_hot_key"], "left").withColumn("_salt", F.when(F.col("_hot_key").isNotNull(), F.pmod(F.xxhash64(*many.columns), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot_key")
    # a row a hot key and salt, so that the copies are made by the join
    salts = F.broadcast(known.select(F.col("_hot_key").alias("_copied_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_copy")))
    copied = one.join(salts, one[key] == salts["_copied_key"], "left").withColumn("_salt", F.coalesce("_copy", F.lit(0))).drop("_copied_key", "_copy")
    return dealt.join(copied.hint("merge"), [key, "_salt"], how).drop("_salt")


#: Words of 64 bits of the bitmap that picks rows by their marks, at most; it has 16 bits a wanted row up to there.
MOST_WORDS = 1 << 19


def marked_rows(rows: DataFrame, wanted: DataFrame, mark: str) -> DataFrame:
    """The rows whose mark, a column of hashes, is among the marks of wanted, a written table, and few others: a bitmap of these is
    broadcast, so that no row is shuffled."""
    words = min(MOST_WORDS, 1 << max(8, (wanted.count() // 4).bit_length()))
    word = F.col(mark).bitwiseAND(F.lit(words - 1))
    bit = f"CAST(shiftrightunsigned({mark}, 40) & 63 AS INT)"
    bits = wanted.groupBy(word.alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(CAST(1 AS BIGINT), {bit})")).alias("_bits"))
    return rows.join(F.broadcast(bits), word == F.col("_word")).filter(F.expr(f"shiftrightunsigned(_bits, {bit}) & 1 = 1")).select(*rows.columns)


def made_of(texts: DataFrame, wanted: DataFrame, work, columns: str) -> DataFrame:
    """node and what work makes of (doc_id, mark, text), for the rows of texts that wanted, a written table (node, doc_id, mark),
    names. work hands on its first two columns; columns says the others.

    Texts are not shuffled, whatever the number of wanted rows: a bitmap of their marks is broadcast and leaves few others, and
    what work makes of those that pass is joined with wanted, which settles the rest.
    """
    made = marked_rows(texts, wanted, "mark").select("doc_id", "mark", "text").mapInArrow(work, f"doc_id long, mark long, {columns}")
    own = wanted.select("node", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).hint("merge")
    joined = made.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    return joined.drop("doc_id", "mark", "_id", "_mark")


def whole_row(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """The row of docs, or these columns of it, as one column `document`; names may hold any character."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in (docs.columns if columns is None else columns)]
    return F.struct(*[F.col(c) for c in quoted]).alias("document")


def first_rows(docs: DataFrame, rows: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows that rows (doc_id, mark, first) marks as not first, mark being the xxhash64 of the text (null:
    empty); rows need not have every row of docs. Of rows that repeat id and text and are first, one is left.

    What goes is anti-joined by id and mark, so few copies move no text; only repeated rows go through an aggregate.
    """
    rows = materialise(rows, "rows")
    gone = rows.filter("NOT first").select("doc_id", "mark").distinct()
    own = docs.select(whole_row(docs), F.col(id_column).cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("own_mark"))
    same = lambda other: own["own_id"].eqNullSafe(other["doc_id"]) & (own["own_mark"] == other["mark"])
    left = own.join(gone, same(gone), "left_anti")
    again = materialise(rows.filter("first").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    if again.isEmpty():
        return left.select("document.*")
    once = own.join(again, same(again), "left_semi").groupBy("own_id", "own_mark").agg(F.first("document").alias("document"))
    return left.join(again, same(again), "left_anti").select("document.*").unionByName(once.select("document.*"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def trimmed(end: Callable[[], None] | None = None) -> Iterator[None]:
    """A Python worker's work on a partition: at its end `end` is called and memory that is free goes back to the system, as
    workers live on and stages that follow may need it."""
    try:
        yield
    finally:
        if end is not None:
            end()
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library, which gives memory back by itself
            pass


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that are run inside hand Python workers at most so many rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (public domain), vectorised over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_column(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string or binary array without nulls, and its n + 1 offsets, without copying the data."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1]] if len(offsets) else data[:0], offsets - first


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []
#: A byte's value in hashes of words: ASCII capitals count as small letters.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)
#: Bytes of text that are worked on at once.
CHUNK = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to at least n; the largest tables yet are kept."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        ones = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        for x in ones:
            x[0] = 1
        _POWERS[:] = [(np.cumprod(ones[0], dtype=np.uint64), np.cumprod(ones[1], dtype=np.uint64))]
    return _POWERS[0]


def slices(column, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The rows of an Arrow text column, some megabytes at a time: first and last row, bytes, offsets."""
    data, offsets = byte_column(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
