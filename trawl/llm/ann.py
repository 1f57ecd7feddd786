"""Operator 2, approximate nearest neighbours: a robust-pruned directed graph (Vamana) in each shard, searched by beams.

Inner product is searched as Euclidean distance: a vector gets one more component, sqrt(M^2 - |x|^2) with M the largest
norm of its shard, a query gets 0 there, which keeps the order exactly. Building inserts points in batches: a greedy search
of the graph so far proposes neighbours, relaxed pruning keeps at most DEGREE of them such that no kept one is closer to a
candidate, times alpha, than the point itself; reverse edges are added, and a list that outgrows SLACK is pruned alike.
Every row is indexed.

Equal vectors are one node; a node carries its smallest TOP + 1 ids, more can never be returned. Shards have at most SHARD
nodes, so a build task is bounded whatever the input. A search task holds a group of shards of about GROUP_BYTES and the
queries stream past it, so the index is moved once, or a few times where there are more cores than groups, and queries once
a group; a query keeps the best TOP of each group, then of all. Scores are taken anew in double precision on the original
vectors.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, as candidates or queries,
nor do those of another length than the commonest one; ties go to the smaller vec_id; a row whose id is null takes no
part; repeated (id, vector) rows count once; fewer candidates than TOP are all returned; other columns are ignored; an
empty table gives an empty result. Recall is measured in the tests and in the README, against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.llm.shared import bounded_batches
from trawl.scratch import Scratch, materialise

TOP = 20
QUERY_EVERY = 20
SHARD = 8192
DEGREE, SLACK, BUILD_BEAM, ALPHA = 32, 48, 48, 1.2
SEARCH_BEAM = 140
EXPAND = 4
BLOCK = 512
GROUP_BYTES = 64 << 20


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, inner products), best first, of the beam that a greedy search of the graph ends with; -1 where it is short.

    x is (n, d); graph is (n, degree) with -1 for no edge. EXPAND unexpanded nodes of each beam are expanded at a time.
    """
    b, n = len(queries), len(x)
    ids = np.full((b, beam), -1, np.int64)
    worth = np.full((b, beam), -np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    ids[:, 0], worth[:, 0], open_[:, 0] = entry, queries @ x[entry], True
    seen[:, entry] = True
    seen[:, n] = True
    rows = np.arange(b)
    while len(rows):
        # beams are sorted, so the first open places are the nearest open nodes
        turn = np.cumsum(open_[rows], axis=1)
        pick = open_[rows] & (turn <= EXPAND)
        at = np.argsort(~pick, axis=1, kind="stable")[:, :EXPAND]
        chosen = np.where(np.take_along_axis(pick, at, 1), np.take_along_axis(ids[rows], at, 1), -1)
        open_[rows] &= ~pick
        near = np.where(chosen[:, :, None] >= 0, graph[chosen], -1).reshape(len(rows), -1)
        near[near < 0] = n
        near.sort(axis=1)
        fresh = ~seen[rows[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[rows[:, None], near] = True
        # only nodes that are new to a query are looked at
        line, place = np.nonzero(fresh)
        value = np.full(near.shape, -np.inf, np.float32)
        value[line, place] = np.einsum("fd,fd->f", x[near[line, place]], queries[rows[line]])
        all_worth = np.concatenate([worth[rows], value], axis=1)
        all_ids = np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1)
        all_open = np.concatenate([open_[rows], fresh], axis=1)
        best = np.argpartition(-all_worth, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_worth, best, 1), axis=1, kind="stable"), 1)
        worth[rows], ids[rows], open_[rows] = (np.take_along_axis(a, best, 1) for a in (all_worth, all_ids, all_open))
        rows = rows[open_[rows].any(axis=1)]
    return ids, worth


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each point at most `degree` of its candidates (-1: none), nearest first, by relaxed pruning; norms are equal."""
    b, c = candidates.shape
    own = candidates == points[:, None]
    order = np.sort(np.where(own, -1, candidates), axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    v = x[order]
    square = float(x[0] @ x[0]) if len(x) else 0.0
    far = 2 * (square - np.einsum("bcd,bd->bc", v, x[points]))
    far[order < 0] = np.inf
    by = np.argsort(far, axis=1, kind="stable")
    order, far = np.take_along_axis(order, by, 1), np.take_along_axis(far, by, 1)
    v = np.take_along_axis(v, by[:, :, None], 1)
    between = 2 * (square - v @ v.transpose(0, 2, 1))
    alive, kept, count = far < np.inf, np.full((b, degree), -1, np.int64), np.zeros(b, np.int64)
    line = np.arange(b)
    for i in range(c):
        take = alive[:, i] & (count < degree)
        if not take.any():
            continue
        kept[line[take], count[take]] = order[take, i]
        count[take] += 1
        alive[take] &= alpha * alpha * between[take, i, :] > far[take]
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, slack: int = SLACK, seed: int = 7) -> tuple[np.ndarray, int]:
    """(graph, entry) over the rows of x, all of one norm; a row of the graph has at most `slack` edges."""
    n = len(x)
    rng = np.random.default_rng(seed)
    graph = np.full((n, slack), -1, np.int64)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    if n <= 1:
        return graph, entry
    start = min(degree // 4, n - 1)
    graph[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
    size = np.full(n, start)
    order = rng.permutation(n)
    for at in range(0, n, BLOCK):
        points = order[at : at + BLOCK]
        found, _ = beam_search(x, graph, entry, x[points], min(beam, n))
        graph[points] = -1
        graph[points, :degree] = robust_prune(x, points, np.concatenate([found, graph[points]], axis=1), alpha, degree)
        size[points] = (graph[points] >= 0).sum(axis=1)
        source, target = np.repeat(points, degree), graph[points, :degree].ravel()
        known = target >= 0
        source, target = source[known], target[known]
        new = ~(graph[target] == source[:, None]).any(axis=1)
        _reverse(x, graph, size, source[new], target[new], alpha, degree)
    return graph, entry


def _reverse(x: np.ndarray, graph: np.ndarray, size: np.ndarray, source: np.ndarray, target: np.ndarray, alpha: float, degree: int) -> None:
    """Add edges target -> source in place: where a list has room they are put behind it, else it is pruned with them."""
    slack = graph.shape[1]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    ends, first, many = np.unique(target, return_index=True, return_counts=True)
    nth = np.arange(len(target)) - np.repeat(first, many)
    fits = np.repeat(size[ends] + many <= slack, many)
    graph[target[fits], size[target[fits]] + nth[fits]] = source[fits]
    roomy = size[ends] + many <= slack
    size[ends[roomy]] += many[roomy]
    for step in range(0, int(many[~roomy].max(initial=0)), slack):
        now = ~fits & (nth >= step) & (nth < step + slack)
        rows, line = np.unique(target[now], return_inverse=True)
        came = np.full((len(rows), slack), -1, np.int64)
        came[line, nth[now] - step] = source[now]
        for part in range(0, len(rows), BLOCK):
            own = rows[part : part + BLOCK]
            pruned = robust_prune(x, own, np.concatenate([graph[own], came[part : part + BLOCK]], axis=1), alpha, degree)
            graph[own] = -1
            graph[own, :degree] = pruned
            size[own] = (pruned >= 0).sum(axis=1)


def _augment(vectors: np.ndarray) -> np.ndarray:
    square = (vectors.astype(np.float64) ** 2).sum(axis=1)
    extra = np.sqrt(np.maximum(0, square.max(initial=0) - square))
    return np.concatenate([vectors, extra[:, None]], axis=1).astype(np.float32)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, ids, vector) of whole shards, sorted by shard -> one row (shard, ids, counts, vectors, graph, entry) each."""

    def index(rows: list[tuple]) -> pa.RecordBatch:
        vectors = np.array([r[2] for r in rows], np.float32)
        graph, entry = build_graph(_augment(vectors))
        counts = np.array([len(r[1]) for r in rows], np.int32)
        ids = np.concatenate([r[1] for r in rows]).astype(np.int64)
        values = [rows[0][0], ids.tobytes(), counts.tobytes(), vectors.tobytes(), graph.astype(np.int32).tobytes(), entry]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["shard", "ids", "counts", "vectors", "graph", "entry"])

    rows: list[tuple] = []
    for batch in batches:
        for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if rows and rows[0][0] != r[0]:
                yield index(rows)
                rows = []
            rows.append(r)
    if rows:
        yield index(rows)


class Shard:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict) -> None:
        self.counts = np.frombuffer(row["counts"], np.int32)
        self.ids, self.edges = np.frombuffer(row["ids"], np.int64), np.concatenate([[0], np.cumsum(self.counts)])
        self.vectors = np.frombuffer(row["vectors"], np.float32).reshape(len(self.counts), -1)
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(len(self.counts), -1)
        self.x, self.entry = _augment(self.vectors), row["entry"]

    def search(self, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line of asked, vec_id, score) of all ids of the nodes that the beams end with."""
        own = np.concatenate([asked, np.zeros((len(asked), 1))], axis=1).astype(np.float32)
        found, _ = beam_search(self.x, self.graph, self.entry, own, min(beam, len(self.counts)))
        line, place = np.nonzero(found >= 0)
        node = found[line, place]
        score = np.concatenate([(self.vectors[node[k : k + 4096]].astype(np.float64) * asked[line[k : k + 4096]]).sum(axis=1) for k in range(0, len(node), 4096)])
        many = self.counts[node]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(line, many), self.ids[np.repeat(self.edges[node], many) + nth], np.repeat(score, many)


def _answers(shards: list[Shard], asked: list[tuple[int, list[float]]], top: int, beam: int) -> pa.RecordBatch:
    """(query_id, vec_id, score) of the best `top` of all the shards for each query."""
    ids, vectors = np.array([a[0] for a in asked], np.int64), np.array([a[1] for a in asked], np.float64)
    line, near, score = (np.concatenate(c) for c in zip(*(s.search(vectors, beam) for s in shards), strict=True))
    other = near != ids[line]
    line, near, score = line[other], near[other], score[other]
    by = np.lexsort((near, -score, line))
    line, near, score = line[by], near[by], score[by]
    nth = np.arange(len(line)) - np.searchsorted(line, line)
    best = nth < top
    return pa.RecordBatch.from_arrays([pa.array(ids[line[best]]), pa.array(near[best]), pa.array(score[best])], ["query_id", "vec_id", "score"])


def _serve(batches: Iterator[pa.RecordBatch], top: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task, shards before queries: the queries are answered block by block from the task's shards."""
    task, shards, asked = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if asked and (len(asked) == BLOCK or row["task"] != task):
                yield _answers(shards, asked, top, beam)
                asked = []
            if row["task"] != task:
                task, shards = row["task"], []
            if row["query_id"] is None:
                shards.append(Shard(row))
            else:
                asked.append((row["query_id"], row["query_vector"]))
    if asked:
        yield _answers(shards, asked, top, beam)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.exists(v, lambda c: c != 0)
    rows = rows.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<float>").alias("vector"))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vector") == (length["d"] if length else 0)).distinct()


def build(rows: DataFrame, shard_size: int = SHARD, top: int = TOP) -> DataFrame:
    """The index over all usable rows, one row a shard, written to the shared folder."""
    bounded_batches(rows.sparkSession)
    first = W.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= top + 1)
    with Scratch(rows.sparkSession) as scratch:
        nodes = scratch.write(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
        shards = max(1, -(-nodes.count() // int(shard_size * 0.95)))
        dealt = nodes.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), "ids", "vector")
        dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
        return materialise(dealt.mapInArrow(_build, "shard int, ids binary, counts binary, vectors binary, graph binary, entry int"), "ann-index")


def search(index: DataFrame, queries: DataFrame, top: int = TOP, beam: int = SEARCH_BEAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the best `top` of all shards for each row (vec_id, vector) of queries."""
    spark = index.sparkSession
    size = index.agg(F.count(F.lit(1)).alias("shards"), F.max(F.length("vectors") * 2 + F.length("graph") + F.length("ids")).alias("bytes")).first()
    if not size["shards"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    each = max(1, group_bytes // size["bytes"])
    groups = -(-size["shards"] // each)
    # with more cores than groups, each group serves several parts of the queries
    parts = max(1, min(-(-spark.sparkContext.defaultParallelism // groups), -(-queries.count() // BLOCK)))
    part = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = index.withColumn("part", part(parts)).select((F.pmod("shard", F.lit(groups)) * parts + F.col("part")).cast("int").alias("task"), "shard", "ids", "counts", "vectors", "graph", "entry")
    asked = queries.withColumn("group", part(groups)).select((F.col("group") * parts + F.pmod(F.xxhash64("vec_id"), F.lit(parts))).cast("int").alias("task"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    rows = held.unionByName(asked, allowMissingColumns=True).repartitionById(groups * parts, F.col("task")).sortWithinPartitions("task", F.col("query_id").asc_nulls_first(), "shard")
    found = rows.mapInArrow(lambda batches: _serve(batches, top, beam), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op2_vamana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row, by inner product, for each row whose vec_id is divisible by 20."""
    rows = materialise(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")), "vectors")
    return search(build(rows), rows.filter(F.col("vec_id") % QUERY_EVERY == 0))
