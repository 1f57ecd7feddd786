"""A flat layout of vectors by their fuzzy neighbour graph (the published UMAP rule; McInnes et al., 2018), as Spark joins.

Equal vectors are one node. Each node's nearest neighbours get memberships exp(-(distance - nearest) / scale), with a scale
such that they add up to log2(k); the graph is their fuzzy union, a + b - ab. From the first two principal components
on, an epoch draws each directed edge with the probability of its weight and moves all nodes at once: along a drawn edge
the tail pulls the head, and it pushes `negatives` random nodes. A node moves by the sum of these over the number of its
pulls, so that a step does not grow with the degree. All draws are hashes of edge and epoch, so a task that is run again
draws the same. Positions are a written table an epoch; nothing but counts of partitions reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import vectors as V
from trawl.operators.clustering import project, with_unit_vectors
from trawl.operators.pivots import nearest_by_pivots
from trawl.scratch import Scratch, materialise

#: Draws are to so many parts of one.
PARTS = 1 << 24
#: A single pull or push is at most this long, and a start lies within this distance.
CLIP, EXTENT = 4.0, 10.0
#: Epochs after which the shuffle files of those before are given back.
GIVEN_BACK = 4


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a, b such that 1 / (1 + a d^2b) is nearest to 1 up to min_dist and exp(-(d - min_dist) / spread) beyond."""
    d = np.linspace(1e-9, 3 * spread, 300)
    wanted = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    at, step = np.array([1.0, 1.0]), np.eye(2) * 1e-6
    off = lambda p: 1 / (1 + p[0] * d ** (2 * p[1])) - wanted
    for _ in range(300):
        now = off(at)
        slope = np.stack([(off(at + s) - now) / 1e-6 for s in step], 1)
        at = np.maximum(at - 0.5 * np.linalg.solve(slope.T @ slope + 1e-9 * np.eye(2), slope.T @ now), 1e-3)
    return float(at[0]), float(at[1])


def memberships(distances: np.ndarray, total: float) -> np.ndarray:
    """exp(-(d - least d over 0) / scale) with the scale at which a row adds up to total; rows are padded with infinity."""
    positive = np.where(distances > 0, distances, np.inf)
    least = positive.min(axis=1, keepdims=True)
    over = np.maximum(distances - np.where(np.isfinite(least), least, 0.0), 0.0)
    low, high, scale = np.zeros(len(over)), np.full(len(over), np.inf), np.ones(len(over))
    for _ in range(64):
        short = np.exp(-over / np.maximum(scale, 1e-12)[:, None]).sum(axis=1) < total
        low, high = np.where(short, scale, low), np.where(short, high, scale)
        scale = np.where(np.isinf(high), scale * 2, (low + high) / 2)
    return np.exp(-over / np.maximum(scale, 1e-12)[:, None])


def fuzzy_graph(neighbours: DataFrame, k: int) -> DataFrame:
    """(tail, head, weight), both directions of each edge, from neighbours (query_id, id, distance), k - 1 a query at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths(), np.int64)
            flat = lists.flatten()
            row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            table = np.full((len(sizes), max(1, int(sizes.max(initial=1)))), np.inf)
            table[row, place] = np.asarray(flat.field("distance"))
            weight = memberships(table, np.log2(k))[row, place]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(0))[row]), flat.field("id"), pa.array(weight)], ["a", "b", "w"])

    lists = neighbours.groupBy("query_id").agg(F.collect_list(F.struct("id", "distance")).alias("l"))
    own = lists.mapInArrow(work, "a long, b long, w double")
    pairs = own.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count("*").alias("n"))
    both = pairs.select("u", "v", F.when(F.col("n") == 2, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("weight"))
    return both.select(F.col("u").alias("tail"), F.col("v").alias("head"), "weight").unionByName(both.select(F.col("v").alias("tail"), F.col("u").alias("head"), "weight"))


def drawn(edges: DataFrame, nodes: int, epoch: int, negatives: int, seed: int) -> DataFrame:
    """(tail, head, pushed): the edges of an epoch, and the nodes that each of them pushes."""
    chance = F.pmod(F.xxhash64("tail", "head", F.lit(seed), F.lit(epoch)), F.lit(PARTS))
    pushed = F.transform(F.sequence(F.lit(1), F.lit(negatives)), lambda j: F.pmod(F.xxhash64("tail", "head", F.lit(seed), F.lit(epoch), j), F.lit(nodes)))
    return edges.filter(chance < F.col("weight") * PARTS).select("tail", "head", pushed.alias("pushed"))


def _force(of: Column, a: float, b: float, pull: Column) -> Column:
    """The factor of the way from the other node, by the squared distance."""
    bend = 1 + a * F.pow(of, F.lit(b))
    towards = F.when(of > 0, -2 * a * b * F.pow(of, F.lit(b - 1)) / bend).otherwise(0.0)
    return F.when(pull, towards).otherwise(2 * b / ((0.001 + of) * bend))


def epoch_moves(positions: DataFrame, edges: DataFrame, nodes: int, epoch: int, epochs: int, a: float, b: float, negatives: int, seed: int) -> DataFrame:
    """(node, x, y) after an epoch."""
    tails = drawn(edges, nodes, epoch, negatives, seed).join(positions.withColumnRenamed("node", "tail"), "tail")
    pushes = F.transform("pushed", lambda t: F.struct(t.cast("long").alias("node"), F.lit(False).alias("pull")))
    sent = tails.select("tail", F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(F.concat(F.array(F.struct(F.col("head").alias("node"), F.lit(True).alias("pull"))), pushes)).alias("to"))
    sent = sent.select(F.col("to.node").alias("node"), F.col("to.pull").alias("pull"), "ox", "oy", "tail").filter("node <> tail").drop("tail")
    met = positions.join(sent, "node", "left")
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    force = _force(dx * dx + dy * dy, a, b, F.col("pull"))
    clip = lambda c: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), c))
    added = met.groupBy("node", "x", "y").agg(F.sum(clip(force * dx)).alias("gx"), F.sum(clip(force * dy)).alias("gy"), F.sum(F.col("pull").cast("int")).alias("pulls"))
    step = (1 - epoch / epochs) / F.greatest(F.coalesce("pulls", F.lit(0)), F.lit(1))
    return added.select("node", (F.col("x") + step * F.coalesce("gx", F.lit(0.0))).alias("x"), (F.col("y") + step * F.coalesce("gy", F.lit(0.0))).alias("y"))


def numbered_rows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows, written, with `node` from 0 without gaps."""
    placed = scratch.write(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    counts = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    ahead, starts = 0, {}
    for p in sorted(counts):
        starts[p], ahead = ahead, ahead + counts[p]
    if not starts:
        return placed.withColumn("node", F.col("_at")).drop("_at")
    at = F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair])
    return placed.withColumn("node", at[F.shiftright("_at", 33)] + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def started(nodes: DataFrame) -> DataFrame:
    """(node, x, y): the first two principal components of the unit vectors, the farthest at EXTENT."""
    flat = project(with_unit_vectors(nodes, "vector"), 2).select("node", F.get("x", 0).alias("x"), F.get("x", 1).alias("y"))
    most = flat.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")).first()["m"] or 1.0
    return flat.select("node", *[(F.col(c) * (EXTENT / most)).alias(c) for c in ("x", "y")])


def layout(rows: DataFrame, key: str, vector: str, k: int = 15, min_dist: float = 0.1, spread: float = 1.0, epochs: int = 60, negatives: int = 5, seed: int = 42) -> DataFrame:
    """(key, x, y) of each row with a vector that has a length; vectors have one number of components, two at least."""
    given = rows.select(F.col(key).alias("_key"), V.doubles(F.col(vector)).alias("vector")).filter("vector IS NOT NULL").filter(V.norm(F.col("vector")) > 0)
    a, b = curve(min_dist, spread)
    with Scratch(rows.sparkSession) as scratch:
        nodes = scratch.write(numbered_rows(given.select("vector").distinct(), scratch), "nodes")
        count = nodes.count()
        if count < 3:
            return materialise(given.join(nodes, "vector").select(F.col("_key").alias(key), F.col("node").cast("double").alias("x"), F.lit(0.0).alias("y")), "layout")
        asked = nodes.select(F.col("node").alias("id"), F.col("vector").alias("embedding"))
        near = nearest_by_pivots(asked, asked, k).filter("query_id <> id").filter(F.col("rank") <= k)
        edges = scratch.write(fuzzy_graph(near.select("query_id", "id", "distance"), k), "edges")
        positions = scratch.write(started(nodes), "positions")
        for epoch in range(epochs):
            positions = scratch.replace(positions, epoch_moves(positions, edges, count, epoch, epochs, a, b, negatives, seed), "positions")
            if epoch % GIVEN_BACK == GIVEN_BACK - 1:
                # shuffle files go when the driver's JVM collects what refers to them, which it has no other reason to do
                rows.sparkSession.sparkContext._jvm.System.gc()
        return materialise(given.join(nodes, "vector").join(positions, "node").select(F.col("_key").alias(key), "x", "y"), "layout")
