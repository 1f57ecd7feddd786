"""Exact work on all pairs of vectors, block by block: blocks of rows are crossed and each pair of blocks is one matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import vectors as V
from trawl.scratch import bounded_batches, materialise

#: Rows of a block.
BLOCK = 2048
#: Queries of a block that are looked at at once.
PART = 128
#: Parts of the right side in `full_silhouettes`, at most: a row's sums leave a task once for each, however many rows there are.
SIDES = 8
#: Blocks of a part of the right side from which on it is cut, and tasks that `full_silhouettes` has at least where blocks allow.
SIDE_BLOCKS, LEAST_TASKS = 128, 96
#: Rows of the left side whose distances to a block are held at once.
TILE = 512
#: Partitions of blocks, at most.
MOST_PARTS = 4000
#: Digits to which distances are compared, so that equal vectors tie.
DIGITS = 12


def blocks(rows: DataFrame, key: str, vector: str, size: int = BLOCK) -> DataFrame:
    """(block, ids, flat): about `size` rows each with their vectors, all of one length, in a row."""
    given = rows.filter(F.col(vector).isNotNull())
    few = given.select(F.col(key).cast("long").alias("_id"), V.doubles(F.col(vector)).alias("_v"))
    n = max(1, -(-few.count() // size))
    packed = few.groupBy(F.pmod(F.xxhash64("_id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("_id", "_v")).alias("_l"))
    return packed.select("block", F.col("_l._id").alias("ids"), F.flatten("_l._v").alias("flat"))


def labelled_blocks(rows: DataFrame, key: str, vector: str, labels: str, size: int) -> DataFrame:
    """(block, flat, marks): `size` rows at most each with their vectors and labels in a row; rows of equal labels are
    neighbours, so that a block has few of them."""
    few = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("_id"), V.doubles(F.col(vector)).alias("v"), F.col(labels).cast("array<int>").alias("m"))
    dealt = few.repartitionByRange(min(MOST_PARTS, max(1, -(-few.count() // size))), "m", "_id").sortWithinPartitions("m", "_id").select("v", "m")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = TaskContext.get().partitionId() << 32, None

        def out(part: pa.Table, number: int) -> pa.RecordBatch:
            flat, marks = (pa.concat_arrays([c.flatten() for c in part.column(n).chunks]) for n in ("v", "m"))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.ListArray.from_arrays([0, len(x)], x) for x in (flat, marks))], ["block", "flat", "marks"])

        for batch in batches:
            left = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch])
            while left.num_rows >= size:
                yield out(left.slice(0, size), at)
                left, at = left.slice(size), at + 1
        if left is not None and left.num_rows:
            yield out(left, at)

    return dealt.mapInArrow(pack, "block long, flat array<double>, marks array<int>")


def _list(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _matrix(batch: pa.RecordBatch, name: str, i: int, n: int) -> np.ndarray:
    return _list(batch, name, i).reshape(n, -1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit rows; rows of length 0 become NaN."""
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.full_like(v, np.nan), where=norm > 0)


def least(d: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the n least entries of each row by rounded distance and id; NaN comes last."""
    d = np.where(np.isnan(d), np.inf, d)
    if d.shape[1] > n:
        cut = np.partition(d, n - 1, axis=1)[:, n - 1 : n] + 2 * 10.0**-DIGITS
        row, column = np.nonzero(d <= cut)
    else:
        row, column = (x.ravel() for x in np.indices(d.shape))
    distance = np.round(d[row, column], DIGITS) + 0.0
    order = np.lexsort((ids[column], distance, row))
    row, column, distance = row[order], column[order], distance[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < n
    return row[kept], column[kept], distance[kept]


def nearest_in(pairs: DataFrame, n: int) -> DataFrame:
    """The n nearest of all pairs of blocks (qids, qflat, ids, flat); a pair of blocks gives n a query at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qids, ids = _list(batch, "qids", i), _list(batch, "ids", i)
                a, b = _unit(_matrix(batch, "qflat", i, len(qids))), _unit(_matrix(batch, "flat", i, len(ids)))
                # equal vectors tie, and all that tie are looked at, so a part of the queries is taken at a time
                for at in range(0, len(qids), PART):
                    row, column, distance = least(1.0 - a[at : at + PART] @ b.T, ids, n)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[row + at]), pa.array(ids[column]), pa.array(distance)], ["query_id", "id", "distance"])

    best = W.partitionBy("query_id").orderBy("distance", "id")
    found = pairs.mapInArrow(work, "query_id long, id long, distance double")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= n)


def nearest_for_all(queries: DataFrame, rows: DataFrame, n: int, key: str = "id", vector: str = "embedding", size: int = BLOCK) -> DataFrame:
    """(query_id, id, distance, rank): the n rows nearest by cosine to each of any number of queries, every row a candidate."""
    asked = blocks(queries, key, vector, size=size).select(F.col("ids").alias("qids"), F.col("flat").alias("qflat"))
    return nearest_in(asked.crossJoin(blocks(rows, key, vector, size=size).select("ids", "flat")), n)


def nearest_within(queries: DataFrame, rows: DataFrame, group: str, n: int, key: str = "id", vector: str = "embedding", size: int = BLOCK) -> DataFrame:
    """As nearest_for_all, but a query meets only the rows of its groups; a large group is cut into several blocks."""

    def packed(frame: DataFrame) -> DataFrame:
        few = frame.filter(F.col(vector).isNotNull()).select(F.col(group).alias("group"), F.col(key).cast("long").alias("_id"), V.doubles(F.col(vector)).alias("_v"))
        many = few.groupBy("group").agg(F.ceil(F.count("*") / size).alias("_n"))
        dealt = few.join(many, "group").withColumn("block", F.pmod(F.xxhash64("_id"), F.col("_n")))
        return dealt.groupBy("group", "block").agg(F.collect_list(F.struct("_id", "_v")).alias("_l")).select("group", F.col("_l._id").alias("ids"), F.flatten("_l._v").alias("flat"))

    asked = packed(queries).select("group", F.col("ids").alias("qids"), F.col("flat").alias("qflat"))
    return nearest_in(asked.join(packed(rows), "group").drop("group"), n)


def full_silhouettes(rows: DataFrame, key: str, vector: str, labels: str, clusters: list[int], size: int = BLOCK) -> list[float]:
    """The mean silhouette over all rows by Euclidean distances of all pairs, for each of several labellings: labels is an
    array with one label below clusters[j] for each j. A row that is alone in its cluster counts 0.

    A cluster's distances are gathered and added up, so a pair costs one distance and an addition for each labelling, not one for
    each cluster.
    """
    packed = materialise(labelled_blocks(rows, key, vector, labels, size), "blocks")
    starts = np.concatenate([[0], np.cumsum(clusters)]).astype(np.int64)
    count, width = len(clusters), int(starts[-1])
    sizes = np.zeros(width)
    for r in rows.select(F.posexplode(labels).alias("j", "c")).groupBy("j", "c").count().collect():
        sizes[starts[r["j"]] + r["c"]] = r["count"]
    many = max(1, packed.count())
    sides = min(SIDES, max(-(-many // SIDE_BLOCKS), -(-LEAST_TASKS // many)))
    left = packed.select(F.col("block").alias("b"), F.col("flat").alias("aflat"), F.col("marks").alias("amarks"))
    # a task meets one part of the right side, block after block, and adds up
    pairs = left.repartitionByRange(min(MOST_PARTS, many), "b").crossJoin(packed.repartition(sides))

    def members(marks: np.ndarray) -> list[tuple[int, slice | np.ndarray]]:
        """Each cluster of a block and its rows there; neighbours need not be gathered."""
        order = np.argsort(marks.T.ravel(), kind="stable")
        found, first = np.unique(marks.T.ravel()[order], return_index=True)
        groups = [x % len(marks) for x in np.split(order, first[1:])]
        return [(int(w), slice(x[0], x[-1] + 1) if x[-1] - x[0] + 1 == len(x) else x) for w, x in zip(found, groups, strict=True)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, told, mine, ones = None, None, None, None, np.ones(size)
        tile, taken = np.empty(size * TILE), np.empty(size * TILE)

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(told), PART):
                part, marks = np.ascontiguousarray(total[:, at : at + PART].T), told[at : at + PART]
                n = len(part)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), w).cast(pa.list_(kind)) for x, w, kind in ((marks, count, pa.int32()), (part, width, pa.float64()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, now)), pa.array(np.arange(at, at + n)), *lists], ["b", "i", "marks", "sums"])

        for batch in batches:
            for i in range(batch.num_rows):
                b, other = batch.column("b")[i].as_py(), batch.column("block")[i].as_py()
                if b != now:  # blocks of the right side follow each other for one of the left
                    if total is not None:
                        yield from out()
                    told = _list(batch, "amarks", i).reshape(-1, count)
                    x = _matrix(batch, "aflat", i, len(told))
                    now, total = b, np.zeros((width, len(told)))
                    mine = np.hstack([-2.0 * x, (x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1))]).T
                marks = _list(batch, "marks", i).reshape(-1, count) + starts[:-1]
                y, groups = _matrix(batch, "flat", i, len(marks)), members(marks)
                # products of these rows and those above are squares of distances
                theirs = np.hstack([y, np.ones((len(y), 1)), (y * y).sum(axis=1, keepdims=True)])
                for at in range(0, len(told), TILE):
                    wide = min(TILE, len(told) - at)
                    d = np.matmul(theirs, mine[:, at : at + wide], out=tile[: len(y) * wide].reshape(len(y), wide))
                    np.sqrt(np.maximum(d, 0.0, out=d), out=d)
                    if b == other:  # a row and itself
                        own = np.arange(wide)
                        d[own + at, own] = 0.0
                    for w, x in groups:
                        met = d[x] if isinstance(x, slice) else np.take(d, x, axis=0, mode="clip", out=taken[: len(x) * wide].reshape(len(x), wide))
                        total[w, at : at + wide] += ones[: len(met)] @ met
        if total is not None:
            yield from out()

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            told = batch.column("sums")
            parts = told.flatten().flatten().to_numpy().reshape(-1, width)
            total = np.add.reduceat(parts, told.offsets.to_numpy()[:-1] - told.offsets[0].as_py(), axis=0)
            marks = batch.column("marks").flatten().to_numpy().reshape(n, count)
            got = np.zeros((n, count))
            for j in range(count):
                part, size_of, c = total[:, starts[j] : starts[j + 1]], sizes[starts[j] : starts[j + 1]], marks[:, j]
                at = np.arange(n)
                own = part[at, c] / np.maximum(size_of[c] - 1, 1)
                mean = np.where(size_of > 0, part / np.maximum(size_of, 1), np.inf)
                mean[at, c] = np.inf
                near = mean.min(axis=1) if mean.shape[1] else np.full(n, np.inf)
                most = np.maximum(own, near)
                fine = (size_of[c] > 1) & np.isfinite(near) & (most > 0)
                got[fine, j] = (near[fine] - own[fine]) / most[fine]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(count), n)), pa.array(got.ravel())], ["j", "s"])

    bounded_batches(rows.sparkSession)
    partial = pairs.mapInArrow(sums, "b long, i long, marks array<int>, sums array<double>")
    # a list of one row's sums has SIDES entries at most
    whole = partial.groupBy("b", "i").agg(F.first("marks").alias("marks"), F.collect_list("sums").alias("sums")).select("marks", "sums")
    means = {r["j"]: r["m"] for r in whole.mapInArrow(values, "j long, s double").groupBy("j").agg(F.avg("s").alias("m")).collect()}
    return [means.get(j, 0.0) for j in range(count)]
