"""Exact nearest neighbours by cosine without all pairs: rows are grouped around pivots, and a query meets only groups whose
bound can hold one of its n nearest.

On unit vectors the Euclidean distance is a metric that rises with the cosine distance, so a row at distance f of a pivot is
at least |d - f| from a query at distance d of it. Each row belongs to its nearest pivot, and a pivot's rows to rings around
it; such a cell is known by its count and its least and largest f. A query first looks into the cells nearest to it, as
many as hold n rows; the n-th distance found there says which cells can matter at all, and rows in these are looked at next.
Only cells (at most MOST_PIVOTS * RINGS) and pivots go to every task. The first look is a join by cell. For the second, blocks
of neighbouring queries meet blocks of neighbouring cells, and which cells of a block a query has to look into is found out
inside the task; so however many cells are open, vectors are sent and written as often as before, and a query's n nearest
leave a task once for each of SIDES parts of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import vectors as V
from trawl.operators.blocks import BLOCK, DIGITS, PART, SIDES, least, nearest_in
from trawl.scratch import Scratch, materialise

MOST_PIVOTS, RINGS, SALTS = 4096, 4, 32
#: Tasks for each of SIDES parts of the rows, at most.
MOST_TASKS = 256
#: Bytes that all pivots have at most, and what bounds are widened by against rounding.
PIVOT_BYTES, SLACK = 1 << 25, 1e-7


def with_length(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, unit) of the rows whose vector has a length."""
    given = rows.select(F.col(key).cast("long").alias("id"), V.doubles(F.col(vector)).alias("_v"))
    return given.filter("_v IS NOT NULL").filter(V.norm(F.col("_v")) > 0).select("id", V.normalised(F.col("_v")).alias("unit"))


def least_copies(rows: DataFrame, n: int) -> DataFrame:
    """rows (id, unit) without those of equal vectors whose ids are not among the n least: none of them can be among the n
    nearest of anything. A vector that many rows have is cut down in parts first."""
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("id"))
    known = rows.withColumn("_h", F.xxhash64("unit")).withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = known.withColumn("_p", place("_h", "unit", "_s")).filter(F.col("_p") <= n)
    return parts.withColumn("_p", place("_h", "unit")).filter(F.col("_p") <= n).select("id", "unit")


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _far(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (units @ pivots.T), 0.0))


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, unit, pivot, far)"""
    given = rows.sparkSession.sparkContext.broadcast(pivots)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                far = _far(_matrix(part.column(1)), given.value)
                own = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], ["id", "unit", "pivot", "far"])

    return rows.mapInArrow(work, "id long, unit array<double>, pivot int, far double")


def _bounds(units: np.ndarray, pivots: np.ndarray, cells: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest distance that a row of each cell can have from each query."""
    d = _far(units, pivots)[:, cells["pivot"]]
    return np.maximum(np.maximum(d - cells["hi"], cells["lo"] - d), 0.0), d + cells["hi"]


def _first_cells(queries: DataFrame, pivots: np.ndarray, cells: dict[str, np.ndarray], n: int) -> DataFrame:
    """(id, unit, cell) from queries (id, unit): the nearest cells that hold n rows together."""
    given = queries.sparkSession.sparkContext.broadcast((pivots, cells))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells = given.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                least, most = _bounds(_matrix(part.column(1)), pivots, cells)
                row, cell = [], []
                for i in range(part.num_rows):
                    order = np.lexsort((most[i], least[i]))
                    found = order[: int(np.searchsorted(np.cumsum(cells["n"][order]), n)) + 1]
                    row.append(np.full(len(found), i))
                    cell.append(cells["cell"][found])
                row, cell = np.concatenate(row), np.concatenate(cell)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32))], ["id", "unit", "cell"])

    return queries.select("id", "unit").mapInArrow(work, "id long, unit array<double>, cell int")


def _binned(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows (a written table) with `bin` and `part`: keys (as many as cells at most) that follow each other share a bin up to
    about `size` rows; a bin of more is cut into parts."""
    known = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(key).toArrow()
    keys, n = known[key].to_numpy(), known["n"].to_numpy()
    bins = (np.cumsum(n) - n) // size
    held = np.bincount(bins, weights=n) if len(n) else n
    told = [(int(k), int(b), int(-(-held[b] // size))) for k, b in zip(keys, bins, strict=True)]
    told = rows.sparkSession.createDataFrame(told, f"{key} int, bin long, parts int")
    return rows.join(F.broadcast(told), key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")


def _merged(query: np.ndarray, ids: np.ndarray, far: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n nearest of each query, in order."""
    order = np.lexsort((ids, far, query))
    query, ids, far = query[order], ids[order], far[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < n
    return query[kept], ids[kept], far[kept]


def _within_reach(pairs: DataFrame, pivots: np.ndarray, cells: dict[str, np.ndarray], n: int, compared=None) -> DataFrame:
    """(query_id, id, distance): of each block of queries (block, qids, near, reach, qflat; near is a query's pivot, in order)
    the n nearest among the blocks of rows (ids, at, flat; at is a row's cell, in order) that follow each other beside it.
    compared is given the pairs that are looked at."""
    order = np.argsort(cells["cell"])
    given = pairs.sparkSession.sparkContext.broadcast((pivots, {c: v[order] for c, v in cells.items()}))
    column = lambda batch, name, i: batch.column(batch.schema.get_field_index(name))[i].values.to_numpy(zero_copy_only=False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells = given.value
        now = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(qids[found[0]]), pa.array(found[1]), pa.array(found[2])], ["query_id", "id", "distance"])

        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                if block != now:
                    if now is not None:
                        yield out()
                    now, qids, near = block, column(batch, "qids", i), column(batch, "near", i)
                    units, reach = column(batch, "qflat", i).reshape(len(qids), -1), column(batch, "reach", i).copy()
                    found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                    starts = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
                    some = [np.arange(a, min(a + PART, b)) for lo, b in zip(starts, np.r_[starts[1:], len(near)], strict=True) for a in range(lo, b, PART)]
                ids, at = column(batch, "ids", i), column(batch, "at", i)
                flat = column(batch, "flat", i).reshape(len(ids), -1)
                heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                ends, own = np.r_[heads[1:], len(at)], np.searchsorted(cells["cell"], at[heads])
                places, which = np.unique(cells["pivot"][own], return_inverse=True)
                d = _far(units, pivots[places])[:, which]
                # a cosine distance is half the square of the distance that bounds are made of
                within = np.sqrt(np.maximum(2 * (reach + 10.0**-DIGITS), 0.0)) + SLACK
                open_ = np.maximum(d - cells["hi"][own], cells["lo"][own] - d) <= within[:, None]
                new, pairs = [found], 0
                for q in some:
                    q = q[open_[q].any(axis=1)]
                    if not len(q):
                        continue
                    seen = np.flatnonzero(open_[q].any(axis=0))
                    rows = slice(None) if len(seen) == len(heads) else np.concatenate([np.arange(heads[k], ends[k]) for k in seen])
                    distance, mine = 1.0 - units[q] @ flat[rows].T, ids[rows]
                    pairs += distance.size
                    fine = distance <= reach[q][:, None] + 2 * 10.0**-DIGITS
                    if fine.sum() > 4 * n * len(q):
                        r, c, far = least(np.where(fine, distance, np.nan), mine, n)
                        r, c, far = (x[np.isfinite(far)] for x in (r, c, far))
                    else:
                        r, c = np.nonzero(fine)
                        far = np.round(distance[r, c], DIGITS) + 0.0
                    new.append((q[r], mine[c], far))
                if len(new) > 1:
                    found = _merged(*(np.concatenate(x) for x in zip(*new, strict=True)), n)
                    last = np.flatnonzero(np.r_[found[0][1:] != found[0][:-1], True]) if len(found[0]) else found[0]
                    last = last[np.bincount(found[0], minlength=len(qids))[found[0][last]] == n]
                    reach[found[0][last]] = np.minimum(reach[found[0][last]], found[2][last])
                if compared is not None:
                    compared.add(pairs)
        if now is not None:
            yield out()

    return pairs.mapInArrow(work, "query_id long, id long, distance double")


#: Queries that go to every task at most, bytes of their vectors at most, and distances that a task computes at once.
FEW_QUERIES, FEW_BYTES, AT_ONCE = 2048, 1 << 24, 1 << 20


def nearest_of_few(queries: DataFrame, rows: DataFrame, n: int, key: str = "id", vector: str = "embedding") -> DataFrame | None:
    """As nearest_by_pivots, for few queries: they go to every task, which reads its rows once and hands on the n nearest of
    them for each query, so neither rows nor their vectors are written or sent. None where there are too many queries."""
    asked = with_length(queries, key, vector).limit(FEW_QUERIES + 1).toArrow()
    units = _matrix(asked["unit"].combine_chunks()) if asked.num_rows else np.zeros((0, 1))
    if len(units) > FEW_QUERIES or units.nbytes > FEW_BYTES:
        return None
    given = rows.sparkSession.sparkContext.broadcast((np.asarray(asked["id"]), units))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, units = given.value
        if not len(qids):
            return
        query, ids, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        reach, step = np.full(len(qids), np.inf), max(16, AT_ONCE // len(qids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                own = np.asarray(part.column(0))
                d = 1.0 - units @ _matrix(part.column(1)).T
                d[d > reach[:, None] + 2 * 10.0**-DIGITS] = np.nan
                row, column, distance = least(d, own, n)
                fine = np.isfinite(distance)
                query, ids, far = np.r_[query, row[fine]], np.r_[ids, own[column[fine]]], np.r_[far, distance[fine]]
                order = np.lexsort((ids, far, query))
                query, ids, far = query[order], ids[order], far[order]
                kept = np.arange(len(query)) - np.searchsorted(query, query) < n
                query, ids, far = query[kept], ids[kept], far[kept]
                last = np.flatnonzero(np.r_[query[1:] != query[:-1], True]) if len(query) else query
                full = np.bincount(query, minlength=len(qids))[query[last]] == n
                reach[query[last[full]]] = far[last[full]]
        yield pa.RecordBatch.from_arrays([pa.array(qids[query]), pa.array(ids), pa.array(far)], ["query_id", "id", "distance"])

    best = W.partitionBy("query_id").orderBy("distance", "id")
    found = with_length(rows, key, vector).mapInArrow(work, "query_id long, id long, distance double")
    return materialise(found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= n), "nearest")


def nearest_by_pivots(queries: DataFrame, rows: DataFrame, n: int, key: str = "id", vector: str = "embedding", size: int = BLOCK, tell: Callable[[int], None] | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the n rows nearest by cosine to each query, ties to smaller ids, as nearest_for_all has
    them; vectors without a length take no part. tell is given the number of pairs that are compared."""
    spark = rows.sparkSession
    with Scratch(spark) as scratch:
        own = scratch.write(least_copies(with_length(rows, key, vector), n), "units")
        count = own.count()
        asked = scratch.write(with_length(queries, key, vector), "queries")
        if not count:
            return materialise(asked.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("rank")).limit(0), "nearest")
        width = own.select(F.size("unit").alias("w")).first()["w"]
        pivots_wanted = int(min(MOST_PIVOTS, max(1, PIVOT_BYTES // (8 * width)), np.ceil(np.sqrt(count))))
        chosen = own.orderBy(F.xxhash64("id"), "id").limit(pivots_wanted).select("unit").toArrow()
        pivots = _matrix(chosen["unit"].combine_chunks())
        placed = scratch.write(_assigned(own, pivots), "assigned")
        radius = placed.groupBy("pivot").agg(F.max("far").alias("radius"))
        ring = F.least(F.floor(F.coalesce(F.try_divide(F.col("far") * RINGS, F.col("radius")), F.lit(0.0))), F.lit(RINGS - 1))
        # at most a row a pivot
        placed = scratch.write(placed.join(F.broadcast(radius), "pivot").withColumn("cell", (F.col("pivot") * RINGS + ring).cast("int")).drop("radius"), "cells")
        summary = placed.groupBy("cell", "pivot").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n")).toArrow()
        cells = {c: summary[c].to_numpy() for c in summary.column_names}
        parts = F.broadcast(spark.createDataFrame([(int(c), int(-(-m // size))) for c, m in zip(cells["cell"], cells["n"], strict=True)], "cell int, parts int"))
        packed = placed.join(parts, "cell").groupBy("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list(F.struct("id", "unit")).alias("_l"))
        packed = packed.select("cell", "part", F.col("_l.id").alias("ids"), F.flatten("_l.unit").alias("flat"))

        # a first look, from which each query knows how far its n nearest are at most
        first = scratch.write(_first_cells(asked, pivots, cells, n), "visits")
        many = first.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
        groups = first.join(many, "cell").groupBy("cell", F.pmod(F.xxhash64("id"), F.col("_n")).alias("_g")).agg(F.collect_list(F.struct("id", "unit")).alias("_q"))
        sent = groups.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("_q.id").alias("qids"), F.flatten("_q.unit").alias("qflat"))
        near = nearest_in(sent.join(packed.hint("merge"), ["cell", "part"]).select("qids", "qflat", "ids", "flat"), n)
        ends = scratch.write(near.groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("_d"), F.count("*").alias("_m")), "ends")
        # without n rows so far every cell matters
        reach = F.when(F.col("_m") >= n, F.col("_d")).otherwise(F.lit(float("inf")))

        least_first = lambda l, by: F.array_sort(F.collect_list(F.struct(by, *l)))
        rows_of = _binned(placed, "cell", size).groupBy("bin", "part").agg(least_first(("id", "unit"), "cell").alias("_l"))
        rows_of = scratch.write(rows_of.select(F.col("_l.id").alias("ids"), F.col("_l.cell").alias("at"), F.flatten("_l.unit").alias("flat")), "blocks")
        placed_queries = scratch.write(_assigned(asked, pivots).join(ends, "id").select("id", "unit", "pivot", reach.alias("reach")), "asked")
        asking = _binned(placed_queries, "pivot", size).groupBy("bin", "part").agg(least_first(("id", "reach", "unit"), "pivot").alias("_l"))
        asking = scratch.write(asking.select(F.monotonically_increasing_id().alias("block"), F.col("_l.id").alias("qids"), F.col("_l.pivot").alias("near"), F.col("_l.reach").alias("reach"), F.flatten("_l.unit").alias("qflat")), "asking")
        # a task meets one part of the rows, block after block, for its blocks of queries
        tasks = max(1, min(MOST_TASKS, asking.count()))
        met = asking.repartition(tasks, "block").crossJoin(rows_of.repartition(SIDES))
        compared = spark.sparkContext.accumulator(0) if tell is not None else None
        best = W.partitionBy("query_id").orderBy("distance", "id")
        found = _within_reach(met, pivots, cells, n, compared).withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= n)
        found = materialise(found, "nearest")
        if tell is not None:
            counts = spark.createDataFrame([(int(c), int(m)) for c, m in zip(cells["cell"], cells["n"], strict=True)], "cell int, n long")
            tell(compared.value + (first.select("cell").join(counts, "cell").agg(F.sum("n")).first()[0] or 0))
        return found
