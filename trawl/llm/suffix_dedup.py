"""Operator 1, suffix-array dedup: removes every byte that lies in a string of LENGTH bytes which also starts elsewhere.

Texts are cut into pieces (see windows.py) and pieces whose core occurs once drop out. The others, equal ones as one with
a weight, form collections of aligned strings, left edge + core + right edge, where the core is one symbol. Each
collection's order and common prefixes are built column by column, a symbol of every string a round, in sequential files
below the shared folder (see columns.py). A window is repeated if its suffix has a common prefix of SPREAD symbols with a
neighbour, or if its piece's weight is over one.

Why pieces: over whole texts such a construction takes as many rounds as the longest text has bytes, each a pass over the
whole transform, which README puts into figures.

Only edges, hashes and positions move between the stages; texts are exchanged by row to be cut and to be digested. Cores are
compared by a 128-bit digest of their bytes, pieces of one core by two independent 64-bit hashes of all their bytes.

Defined cases: a null text is the empty text; matches do not cross rows; rows that repeat (id and text) count as separate
rows and remove each other; texts shorter than LENGTH bytes stay whole; texts of any length are taken whole, a part at a
time; an id may be null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.columns import Collection
from trawl.llm.shared import bounded_batches, documents, salted_join, slices
from trawl.llm.windows import LENGTH, SPREAD, pieces
from trawl.scratch import Scratch, materialise

#: Strings of one construction, if its cores are small; a core is never divided.
STRINGS = 100_000
#: Bytes of text that are cut at once; a longer text is taken in parts that overlap by a window.
CHUNK = 1 << 19
#: Distinct strings of one core from which the collection is split, and distances of a split.
COLLECTION_LIMIT = 300_000
NARROW = 5
#: Tasks that share a heavy core.
SALTS = 64
#: A text's key: its id, and a hash that tells apart the texts of one id.
ROW = ("id", "mark")
PIECE = ("core", "piece", "twin")


def _find_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, text) -> its pieces, with places counted from the text's start."""
    for batch in batches:
        for at, _, whole, bounds in slices(batch.column(2), CHUNK):
            size = len(whole)
            # only a slice of one text can be longer than 2 * CHUNK
            steps = range(0, max(1, size - LENGTH + 1), CHUNK) if size > 2 * CHUNK else (0,)
            for begin in steps:
                data = whole[begin : begin + CHUNK + LENGTH - 1] if size > 2 * CHUNK else whole
                offsets = np.array([0, len(data)]) if size > 2 * CHUNK else bounds
                found = pieces(data, offsets)
                rows = pa.array(found["text"] + at)
                place = (found["core_at"] - offsets[found["text"]] + begin).astype(np.int32)
                sides = [pa.array(found[k].astype(np.int16)) for k in ("left", "right")]
                hashes = [pa.array(found[k].view(np.int64)) for k in PIECE]
                runs = [pa.array(found[k].astype(np.int32)) for k in ("times", "reach")]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place), *sides, *hashes, *runs], [*ROW, "core_at", "left", "right", *PIECE, "times", "reach"])


FOUND = "id long, mark long, core_at int, left short, right short, core long, piece long, twin long, times int, reach int"


def _cut_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, list of pieces) -> (core, check, piece, twin, weight, edges): check is a digest of the core's bytes."""
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_py().encode("utf-8")
            fields = wanted.values
            place, left, right = (fields.field(k).to_pylist() for k in ("core_at", "left", "right"))
            width = LENGTH - SPREAD + 1
            check = pa.array([hashlib.blake2b(raw[p : p + width], digest_size=16).digest() for p in place], pa.binary())
            edges = [pa.array([raw[p - a : p] for p, a in zip(place, left, strict=True)], pa.binary()), pa.array([raw[p + width : p + width + b] for p, b in zip(place, right, strict=True)], pa.binary())]
            core, piece, twin, weight = (fields.field(k) for k in (*PIECE, "weight"))
            yield pa.RecordBatch.from_arrays([core, check, piece, twin, weight, *edges], ["core", "check", "piece", "twin", "weight", "left", "right"])


STRINGS_SCHEMA = "core long, check binary, piece long, twin long, weight long, left binary, right binary"
RUNS = "core long, piece long, twin long, near short, far short"


def _construct(batches: Iterator[pa.RecordBatch], spread: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Rows of STRINGS_SCHEMA sorted by core -> RUNS: repeated window starts, as first and last distance before the core."""

    def built(rows: pa.Table) -> pa.RecordBatch:
        digests = np.frombuffer(b"".join(rows["check"].to_pylist()), np.uint64).reshape(-1, 2)
        core = np.unique(np.column_stack([np.asarray(rows["core"]).view(np.uint64), digests]), axis=0, return_inverse=True)[1].ravel()
        collection = Collection(core, rows["left"].to_pylist(), rows["right"].to_pylist(), spread, folder)
        try:
            own, near, far = collection.repeated(np.asarray(rows["weight"]))
        finally:
            collection.close()
        keys = [rows[k].combine_chunks().take(pa.array(own)) for k in PIECE]
        return pa.RecordBatch.from_arrays([*keys, pa.array(near, pa.int16()), pa.array(far, pa.int16())], [*PIECE, "near", "far"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        while size >= STRINGS:
            table = pa.Table.from_batches(held)
            core = np.asarray(table["core"])
            # up to the last change of core
            edge = np.flatnonzero(core[1:] != core[:-1])
            if not len(edge):
                break
            cut = int(edge[min(len(edge) - 1, int(np.searchsorted(edge, STRINGS)))]) + 1
            yield built(table.slice(0, cut))
            rest = table.slice(cut)
            held, size = rest.to_batches(), rest.num_rows
    if size:
        yield built(pa.Table.from_batches(held))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, starts, ends of repeated windows) -> the contract's columns and the remaining text."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw = text.as_py().encode("utf-8")
            first = last = np.zeros(0, np.int64)
            if spans.is_valid and len(spans):
                start, end = (np.asarray(spans.values.field(k), np.int64) for k in ("start", "end"))
                by = np.argsort(start, kind="stable")
                start, reach = start[by], np.maximum.accumulate(end[by])
                head = np.concatenate([[True], start[1:] > reach[:-1]])
                first, last = start[head], reach[np.append(np.flatnonzero(head)[1:], len(start)) - 1]
            left = b"".join(raw[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(raw)], strict=True))
            for c, v in zip(out, (len(raw), len(raw) - len(left), len(first), hashlib.sha256(left).hexdigest(), left), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def constructed(strings: DataFrame, folder: str, spread: int = SPREAD) -> DataFrame:
    return strings.repartition("core").sortWithinPartitions("core", "piece").mapInArrow(lambda batches: _construct(batches, spread, folder), RUNS)


def constructed_narrow(strings: DataFrame, folder: str, narrow: int = NARROW) -> DataFrame:
    """As constructed, for collections that are too large for one task: each is split by ranges of `narrow` distances.

    The windows of a range share more than the core, LENGTH - narrow + 1 bytes; strings that differ there cannot have a
    window in common, so these bytes are the split's cores. Equal strings of a split enter once, with their weights' sum.
    """
    ranges = strings.select("*", F.explode(F.sequence(F.lit(0), F.lit((SPREAD - 1) // narrow))).alias("k")).withColumns({"a": F.col("k") * narrow, "b": F.greatest(F.lit(0), SPREAD - (F.col("k") + 1) * narrow)})
    ranges = ranges.filter("length(left) >= a AND length(right) >= b")
    inner_left, inner_right = F.expr("substr(left, length(left) - a + 1, a)"), F.expr("substr(right, 1, b)")
    outer_left = F.expr(f"substr(left, greatest(1, length(left) - a - {narrow - 2}), least({narrow - 1}, length(left) - a))")
    outer_right = F.expr(f"substr(right, b + 1, {narrow - 1})")
    cut = ranges.select(
        F.col("core").alias("_core"), F.col("piece").alias("_piece"), F.col("twin").alias("_twin"), "k", "weight", F.xxhash64("core", "k", inner_left, inner_right).alias("core"),
        F.unhex(F.md5(F.concat(F.col("check"), F.encode(F.col("k").cast("string"), "utf-8"), F.lit(b":"), F.encode(F.length(inner_left).cast("string"), "utf-8"), F.lit(b":"), inner_left, inner_right))).alias("check"),
        outer_left.alias("left"), outer_right.alias("right"),
    ).withColumns({"piece": F.xxhash64("core", "left", "right"), "twin": F.xxhash64("right", "check", "left")})
    own = cut.groupBy("core", "check", "piece", "twin").agg(F.sum("weight").alias("weight"), F.first("left").alias("left"), F.first("right").alias("right"))
    found = constructed(own.select("core", "check", "piece", "twin", "weight", "left", "right"), folder, narrow)
    back = cut.join(found, list(PIECE))
    shift = F.col("k") * narrow
    return back.select(F.col("_core").alias("core"), F.col("_piece").alias("piece"), F.col("_twin").alias("twin"), (F.col("near") + shift).cast("short").alias("near"), (F.col("far") + shift).cast("short").alias("far"))


def repeated_windows(texts: DataFrame, scratch: Scratch, collection_limit: int = COLLECTION_LIMIT) -> DataFrame:
    """(id, mark, start, end): runs of repeated windows of texts (id, mark, text), as byte ranges of the row's text."""
    folder = scratch.folder("columns")
    found = texts.select(*ROW, "text").mapInArrow(_find_pieces, FOUND)
    often = scratch.write(found.groupBy("core").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("runs")).filter("n > 1"), "cores")
    # cores that hold a thousandth of the repeats, so a thousand at most, are dealt over SALTS tasks
    total = often.agg(F.sum("runs")).first()[0] or 0
    heavy = F.col("runs") * 1000 >= F.lit(max(total, 1000 * 1000))
    hot = F.broadcast(often.filter(heavy).select("core", F.lit(True).alias("hot")))
    salted = found.join(hot, "core", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("mark", "core_at"), F.lit(SALTS))).otherwise(0).cast("int"))
    spread = often.select("core", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    kept = scratch.write(salted.join(spread, ["core", "salt"], "left_semi").drop("hot", "salt"), "pieces")
    unique = scratch.write(kept.groupBy(*PIECE).agg(F.min(F.struct(*ROW, "core_at", "left", "right")).alias("at"), F.sum("times").alias("weight"), F.count(F.lit(1)).alias("runs")), "unique")
    wanted = unique.groupBy(F.col("at.id").alias("id"), F.col("at.mark").alias("mark")).agg(F.collect_list(F.struct("at.core_at", "at.left", "at.right", *PIECE, "weight")).alias("wanted"))
    same = lambda other: texts["id"].eqNullSafe(other["id"]) & (texts["mark"] == other["mark"])
    one = wanted.hint("merge")
    strings = texts.join(one, same(one)).select("text", "wanted").mapInArrow(_cut_strings, STRINGS_SCHEMA)
    large = scratch.write(unique.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > collection_limit).select("core"), "large")
    if large.isEmpty():
        runs = constructed(strings, folder)
    else:
        strings = scratch.write(strings, "strings")
        runs = constructed(strings.join(large, "core", "left_anti"), folder).unionByName(constructed_narrow(strings.join(large, "core", "left_semi"), folder))
    runs = scratch.write(runs.groupBy(*PIECE).agg(F.collect_list(F.struct("near", "far")).alias("hits")).withColumn("key", F.struct(*PIECE)).select("key", "hits"), "runs")
    keyed = kept.select(F.struct(*PIECE).alias("key"), *ROW, "core_at", "reach")
    hit = salted_join(keyed, runs, "key", counts=unique.select(F.struct(*PIECE).alias("key"), F.col("runs").alias("n"))).select(*ROW, "core_at", "reach", F.explode("hits").alias("hit"))
    return hit.select(*ROW, (F.col("core_at") - F.col("hit.far")).alias("start"), (F.col("core_at") + F.col("reach") - F.col("hit.near") + LENGTH).alias("end"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", collection_limit: int = COLLECTION_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs; kept holds the remaining bytes."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        spans = repeated_windows(texts, scratch, collection_limit).distinct().groupBy(*ROW).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        spans = materialise(spans, "spans")
    there = spans.hint("merge")
    joined = texts.join(there, texts["id"].eqNullSafe(there["id"]) & (texts["mark"] == there["mark"]), "left").select(texts["id"], "text", "spans")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
