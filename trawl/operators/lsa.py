"""Truncated SVD of a sparse term matrix, by passes of block Krylov iteration over sparse rows, and projection to it.

The matrix is a written table of sparse rows. A pass multiplies it by a thin dense block and the result by its transpose:
tasks sum their own part as (terms x width), the parts are added by term in Spark, and only the sum of this size reaches the
driver, whatever the rows; terms are bounded by the vocabulary. After each pass the best values of all blocks so far are
taken (Rayleigh and Ritz), until these stand still. The singular values are those of a
tall-skinny QR of the projected rows, reduced from triangle to triangle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.operators import textstats as S
from trawl.scratch import materialise

#: Entries of sparse rows that are multiplied at once, and triangles that one task reduces to one.
PIECE, FAN = 1 << 16, 64


@dataclass(frozen=True)
class Decomposition:
    """components is terms x k, its columns the right singular vectors; explained is the share of the column variances that
    the projected columns hold."""

    values: np.ndarray
    components: np.ndarray
    explained: float


def sparse_rows(weights: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(key, cols, vals) of (key, term, weight), whose terms are a bounded vocabulary, and their number; terms are numbered by name."""
    numbered = weights.select("term").distinct().withColumn("col", (F.row_number().over(W.orderBy("term")) - 1).cast("int"))
    terms = numbered.count()
    # a vocabulary has a limit
    rows = weights.join(F.broadcast(numbered), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("col", "weight"))).alias("_l"))
    return rows.select(key, F.col("_l.col").alias("cols"), F.col("_l.weight").alias("vals")), terms


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """first and last row, columns, values and row numbers of some rows of a batch (.., cols, vals) at a time."""
    cols, vals = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    sizes = np.asarray(cols.value_lengths().fill_null(0), np.int64)
    ends, flat, weight = np.cumsum(sizes), np.asarray(cols.flatten(), np.int64), np.asarray(vals.flatten(), float)
    at = 0
    while at < len(sizes):
        start = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, start + PIECE, "right")))
        yield at, to, flat[start : ends[to - 1]], weight[start : ends[to - 1]], np.repeat(np.arange(to - at), sizes[at:to])
        at = to


def _summed(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of values added by index, which rises."""
    out = np.zeros((size, values.shape[1]))
    if len(index):
        first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
        out[index[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _times(rows: np.ndarray, at: np.ndarray, by: np.ndarray) -> np.ndarray:
    """rows[at], each times its number."""
    out = rows[at]
    out *= by[:, None]
    return out


def _dense(block, terms: int) -> np.ndarray:
    return np.frombuffer(block.value, float).reshape(terms, -1)


def gram_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """A'A block for the matrix A of rows (cols, vals)."""
    terms, width = block.shape
    given = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(block).tobytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, total = _dense(given, terms), np.zeros((terms, width))
        for batch in batches:
            for at, to, cols, vals, row in _pieces(batch):
                image = _summed(row, _times(dense, cols, vals), to - at)
                # few terms sort by their digits
                order = np.argsort(cols.astype(np.uint16) if terms <= 1 << 16 else cols, kind="stable")
                cols = cols[order]
                first = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]]) if len(cols) else cols
                if len(first):
                    total[cols[first]] += np.add.reduceat(_times(image, row[order], vals[order]), first, axis=0)
        held = np.flatnonzero(total.any(axis=1))
        for k in range(0, len(held), 1024):
            own = held[k : k + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) * width + 1, width, dtype=np.int32)), pa.array(total[own].ravel()))], ["col", "v"])

    parts = rows.select("cols", "vals").mapInArrow(work, "col int, v array<double>")
    found = parts.groupBy("col").agg(*[F.sum(F.get("v", i)).alias(f"v{i}") for i in range(width)]).toArrow()
    out = np.zeros((terms, width))
    out[np.asarray(found["col"])] = np.stack([np.asarray(found[f"v{i}"]) for i in range(width)], axis=1).reshape(-1, width)
    given.destroy()
    return out


def projected(rows: DataFrame, key: str, components: np.ndarray) -> DataFrame:
    """(key, vector): the rows in the space of the components."""
    terms, width = components.shape
    given = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(components).tobytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _dense(given, terms)
        for batch in batches:
            for at, to, cols, vals, row in _pieces(batch):
                image = _summed(row, _times(dense, cols, vals), to - at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (to - at) * width + 1, width, dtype=np.int32)), pa.array(image.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], [key, "vector"])

    kept = rows.select(key, "cols", "vals")
    return kept.mapInArrow(work, f"{kept.schema[0].simpleString().replace(':', ' ', 1)}, vector array<double>")


def triangle(vectors: DataFrame, width: int) -> np.ndarray:
    """R of the QR decomposition of all rows of vectors (vector), by QR of parts and then of FAN triangles at a time."""

    def reduced(blocks: Iterator[np.ndarray]) -> np.ndarray:
        now = np.zeros((0, width))
        for block in blocks:
            now = np.linalg.qr(np.vstack([now, block]), "r")
        return now

    def out(part: int, r: np.ndarray) -> pa.Table:
        return pa.table({"part": pa.array(np.full(len(r), part, np.int64)), "vector": pa.ListArray.from_arrays(pa.array(np.arange(0, r.size + 1, width, dtype=np.int32)), pa.array(r.ravel()))})

    def rows_of(column) -> np.ndarray:
        return np.asarray(column.flatten(), float).reshape(-1, width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = reduced(rows_of(b.column(0).slice(k, 4096)) for b in batches for k in range(0, b.num_rows, 4096))
        yield from out(TaskContext.get().partitionId(), r).to_batches()

    schema = "part long, vector array<double>"
    parts = materialise(vectors.select("vector").mapInArrow(work, schema), "triangles")
    count = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while count > FAN:
        grouped = parts.withColumn("part", F.floor(F.col("part") / FAN))
        parts = grouped.groupBy("part").applyInArrow(lambda t: out(t["part"][0].as_py(), reduced([rows_of(t["vector"].combine_chunks())])), schema)
        count = -(-count // FAN)
    found = parts.select("vector").toArrow()["vector"]
    return reduced([rows_of(found.combine_chunks())]) if len(found) else np.zeros((0, width))


def _beside(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what block adds to basis; nothing where it adds nothing but rounding."""
    scale = max(1e-300, float(np.abs(block).max(initial=0.0)))
    rest = block / scale
    for _ in range(2):
        rest = rest - basis @ (basis.T @ rest)
    u, s, _ = np.linalg.svd(rest, full_matrices=False)
    u = u[:, s > 1e-10]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def truncated_svd(rows: DataFrame, terms: int, k: int, documents: int, more: int = 10, passes: int = 16, tolerance: float = 1e-9, cycles: int = 3, seed: int = 42) -> Decomposition:
    """The first k singular values and right vectors of rows (cols, vals), a written table of at most `documents` rows, the
    rest being zero; not centred. Ends as no square of a singular value has moved by more than tolerance times the largest in two
    passes one after the other. All blocks so far are one subspace, which gains far more from a pass than one that starts anew
    after a few; after `passes` its best part is what the next cycle starts with."""
    k = min(k, terms)
    start = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, min(k + more, terms))))[0]
    last, calm = None, 0
    for _ in range(cycles):
        basis, images = [start], []
        while True:
            images.append(gram_times(rows, basis[-1]))
            whole = np.hstack(basis)
            inner = whole.T @ np.hstack(images)
            values, mixed = np.linalg.eigh((inner + inner.T) / 2)
            best = np.argsort(-values)[: basis[0].shape[1]]
            now = np.maximum(values[best[:k]], 0.0)
            calm = calm + 1 if last is not None and np.abs(now - last).max(initial=0.0) <= tolerance * max(now.max(initial=0.0), 1e-300) else 0
            last, fresh = now, _beside(images[-1], whole)
            if calm >= 2 or not fresh.shape[1] or len(images) == passes:
                break
            basis.append(fresh)
        start = whole @ mixed[:, best]
        if calm >= 2 or not fresh.shape[1]:
            break
    first = start[:, :k]
    _, s, turned = np.linalg.svd(triangle(projected(rows.withColumn("_k", F.lit(0)), "_k", first), first.shape[1]), full_matrices=False)
    components = first @ turned.T
    # a component's largest entry is positive
    largest = np.abs(components).argmax(axis=0)
    components = components * np.where(components[largest, np.arange(components.shape[1])] < 0, -1.0, 1.0)
    sums = rows.select(F.explode(F.arrays_zip("cols", "vals")).alias("e")).groupBy(F.col("e.cols").alias("c")).agg(F.sum("e.vals").alias("s"), F.sum(F.col("e.vals") ** 2).alias("q")).toArrow()
    mean = np.zeros(terms)
    mean[np.asarray(sums["c"])] = np.asarray(sums["s"]) / max(documents, 1)
    total = float(np.asarray(sums["q"]).sum()) / max(documents, 1) - float(mean @ mean)
    held = (s**2 / max(documents, 1)).sum() - float(((mean @ components) ** 2).sum())
    return Decomposition(s, components, float(held / total) if total > 0 else 0.0)


def term_space(docs: DataFrame, key: str, text: str, features: int = 15_000) -> tuple[DataFrame, int]:
    """Sparse TF-IDF rows of docs and the number of terms. Words are counted once, and counts and weights are written, as several
    sums read each of them."""
    counts = materialise(S.term_counts(docs, key, text), "counts")
    return sparse_rows(materialise(S.tfidf(counts, key, docs.count(), features), "weights"), key)
