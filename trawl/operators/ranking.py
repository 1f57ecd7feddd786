"""Retrieval and ranking operators: nearest neighbours, reranking, score scaling, NDCG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import vectors as V

#: How many candidates are fetched before the filter by model.
OVERFETCH, LEAST_CANDIDATES = 50, 1000


def nearest(rows: DataFrame, query: Column, metric: str, key: str, n: int, vector: str = "embedding") -> DataFrame:
    """The n rows nearest to one vector; a partial top-n in each partition, then a merge."""
    return rows.withColumn("distance", V.distance(metric, F.col(vector), query)).orderBy("distance", key).limit(n)


def nearest_then_filter(rows: DataFrame, query: Column, metric: str, key: str, n: int, condition: Column) -> DataFrame:
    """Candidates over all models first, then the filter, then n: may give fewer than n, as an index with a filter does."""
    candidates = nearest(rows, query, metric, key, max(OVERFETCH * n, LEAST_CANDIDATES))
    return candidates.filter(condition).orderBy("distance", key).limit(n)


def rerank(candidates: DataFrame, score: str, position: str, n: int, by: str | None = None) -> DataFrame:
    """Highest score first, ties in input order, n kept; per group if `by` is given."""
    if by is None:
        return candidates.orderBy(F.desc(score), position).limit(n)
    own = W.partitionBy(by).orderBy(F.desc(score), position)
    return candidates.withColumn("new_rank", F.row_number().over(own).cast("long")).filter(F.col("new_rank") <= n)


def minmax(score: str, by: str) -> Column:
    own = W.partitionBy(by)
    return F.try_divide(F.col(score) - F.min(score).over(own), F.max(score).over(own) - F.min(score).over(own))


def _with_group(rows: DataFrame, by: str, **figures: Column) -> DataFrame:
    """rows with figures of their group, summed up where they lie and joined back, so that no group meets in a task."""
    stats = rows.groupBy(F.col(by).alias("_by")).agg(*[c.alias(n) for n, c in figures.items()])
    return rows.join(stats, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def minmax_by(rows: DataFrame, score: str, by: str, name: str) -> DataFrame:
    """rows with `name`, as minmax has it, for groups of any size."""
    told = _with_group(rows, by, _low=F.min(score), _high=F.max(score))
    return told.withColumn(name, F.try_divide(F.col(score) - F.col("_low"), F.col("_high") - F.col("_low"))).drop("_low", "_high")


def zscore_by(rows: DataFrame, score: str, by: str, name: str) -> DataFrame:
    """rows with `name`, (score - mean) / (population standard deviation + 1e-8), for groups of any size."""
    told = _with_group(rows, by, _mean=F.avg(score), _std=F.stddev_pop(score))
    return told.withColumn(name, (F.col(score) - F.col("_mean")) / (F.col("_std") + 1e-8)).drop("_mean", "_std")


def pseudo_by(rows: DataFrame, by: str, order: str, bucket: Column, name: str) -> DataFrame:
    """rows with `name`, (n - rank) / n with ranks from 1 in a group of n, for groups of any size; bucket as in `numbered`."""
    told = numbered(rows, by, order, bucket, "_number")
    return told.withColumn(name, (F.col("group_size") - F.col("_number") - 1) / F.col("group_size")).drop("_number", "group_size")


def ndcg(rows: DataFrame, by: str, score: str, gain: str, k: int, ideal_over_all: bool = False) -> DataFrame:
    """(by, ndcg): discounted gains at k. Tied scores share their mean gain; all-zero gains give 0.

    The ideal order is that of the same k rows, or with ideal_over_all of the whole list.
    """
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), F.desc(gain))))
    cut = ranked if ideal_over_all else ranked.filter(F.col("_r") <= k)
    tied = cut.withColumn("_g", F.avg(gain).over(W.partitionBy(by, score)))
    best = tied.withColumn("_b", F.row_number().over(W.partitionBy(by).orderBy(F.desc(gain))))
    part = lambda g, r: F.sum(F.when(F.col(r) <= k, F.col(g) / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    sums = best.groupBy(by).agg(part("_g", "_r").alias("dcg"), part(gain, "_b").alias("ideal"))
    return sums.select(by, F.when(F.col("ideal") == 0, 0.0).otherwise(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def mean_ndcg(curves: DataFrame, k: str = "k", value: str = "ndcg") -> DataFrame:
    """Mean a k over queries, without NaN; null where none is left."""
    return curves.groupBy(k).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias("mean_ndcg"))


def equal_length(a: Column, b: Column) -> tuple[Column, Column]:
    """Both lists cut to the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def numbered(rows: DataFrame, by: str, order: str, bucket: Column, name: str = "number") -> DataFrame:
    """rows with their number from 0 by order within `by`, and `group_size`. bucket does not fall as order rises, so that rows
    of a large group are numbered in as many tasks as it has buckets, whose counts alone are summed up in one."""
    placed = rows.withColumn("_b", bucket)
    sizes = placed.groupBy(F.col(by).alias("_g"), F.col("_b").alias("_k")).agg(F.count("*").alias("_n"))
    own = W.partitionBy("_g")
    starts = sizes.select("_g", "_k", (F.sum("_n").over(own.orderBy("_k")) - F.col("_n")).alias("_start"), F.sum("_n").over(own).alias("group_size"))
    local = placed.withColumn("_local", F.row_number().over(W.partitionBy(by, "_b").orderBy(order)) - 1)
    joined = local.join(starts, F.col(by).eqNullSafe(F.col("_g")) & F.col("_b").eqNullSafe(F.col("_k")))
    return joined.withColumn(name, F.col("_start") + F.col("_local")).select(*rows.columns, name, "group_size")
