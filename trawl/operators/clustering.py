"""Clustering operators: k-means with exact silhouettes, SVD variance, outliers, relabelling, MMR."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import vectors as V


def with_unit_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    rows = rows.withColumn("_raw", array_to_vector(F.col(vector).cast("array<double>")))
    return Normalizer(inputCol="_raw", outputCol="features", p=2.0).transform(rows).drop("_raw")


def kmeans(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """rows with `cluster`, fitted on L2-normalised vectors; rows has features."""
    model = KMeans(k=k, seed=seed, distanceMeasure="euclidean", featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows)


def kmeans_scan(rows: DataFrame, ks: list[int]) -> DataFrame:
    """rows with the clusters of kmeans for each k as c<k>; rows is persisted. The fits run side by side, since the jobs of one
    are too short to fill a cluster."""
    rows.count()
    estimators = [KMeans(k=k, seed=42, distanceMeasure="euclidean", featuresCol="features", predictionCol=f"c{k}") for k in ks]
    with ThreadPool(len(ks)) as pool:
        fit = inheritable_thread_target(rows.sparkSession)(lambda e: e.fit(rows))
        for model in pool.map(fit, estimators):
            rows = model.transform(rows)
    return rows


def exact_silhouette(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(id, cluster, silhouette) by the cosine distances of all pairs, in linear work; noise (-1) is left out.

    The mean cosine distance of a row to a cluster is 1 - u . mean of the cluster's unit vectors, with the row itself taken
    out of its own cluster. A row that is alone in its cluster, and one of length 0, count 0. Only clusters are broadcast.
    """
    real = rows.filter(F.col(cluster) != -1).withColumn("_u", V.normalised(F.col(vector))).withColumn("_fine", V.norm(F.col(vector)) > 0)
    fine = real.filter("_fine")
    dims = fine.select(F.col(cluster).alias("_l"), F.posexplode("_u")).groupBy("_l", "pos").agg(F.sum("col").alias("s"), F.count("*").alias("n"))
    sums = dims.groupBy("_l").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("_sum"), F.max("n").alias("_n"))
    table = sums.agg(F.collect_list(F.struct("_l", "_sum", "_n")).alias("_table"))
    own = lambda c: c["_l"] == F.col(cluster)
    joined = real.join(F.broadcast(table), F.lit(True))
    to = F.transform("_table", lambda c: F.struct(own(c).alias("own"), F.when(own(c), 1.0 - F.try_divide(V.dot(F.col("_u"), c["_sum"]) - V.dot(F.col("_u"), F.col("_u")), c["_n"] - 1)).otherwise(1.0 - V.dot(F.col("_u"), c["_sum"]) / c["_n"]).alias("d")))
    means = joined.withColumn("_d", to)
    least = lambda mine: F.array_min(F.transform(F.filter("_d", lambda x: x["own"] == F.lit(mine)), lambda x: x["d"]))
    ab = means.select("id", cluster, F.when(F.col("_fine"), least(True)).alias("a"), F.when(F.col("_fine"), least(False)).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.select("id", cluster, value.alias("silhouette"))


def first_best(scores: list[tuple[int, float]]) -> int:
    """The k of the first highest score: a later equal one does not replace it."""
    best = scores[0]
    for k, s in scores[1:]:
        if s > best[1]:
            best = (k, s)
    return best[0]


def explained_variance(rows: DataFrame, vector: str, k: int) -> float:
    """Share of the column variances that the first k left-singular components hold, without centring.

    From the matrix of inner products of columns, which the JVM sums over the rows, and the columns' means: component v has
    the sum of squares of its eigenvalue and the mean of the columns' means along v.
    """
    given = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    means = given.agg(Summarizer.metrics("mean", "count").summary(F.col("_v")).alias("s")).select("s.mean", "s.count").first()
    n = means["count"]
    if n < 2:
        return 0.0
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(given, "_v")).computeGramianMatrix().toArray()
    mean = means["mean"].toArray()
    total = float(gram.trace() - n * mean @ mean) / (n - 1)
    values, components = np.linalg.eigh(gram)
    first = np.argsort(-values)[:k]
    held = (values[first] - n * (mean @ components[:, first]) ** 2) / (n - 1)
    return float(held.sum()) / total if total > 0 else 0.0


def project(rows: DataFrame, k: int = 2) -> DataFrame:
    """rows with `x`: principal components of features."""
    return PCA(k=k, inputCol="features", outputCol="_p").fit(rows).transform(rows).withColumn("x", vector_to_array("_p")).drop("_p")


def outliers(rows: DataFrame, label: str, vector: str, t: float = 2.0) -> DataFrame:
    """rows with `kept_label`: -1 where the cosine distance to the mean of the cluster's unit vectors is over mean + t std.

    Noise stays, clusters of one stay whole. Means are summed by (label, component); no cluster meets in a task.
    """
    unit = rows.withColumn("_u", V.normalised(F.col(vector)))
    dims = unit.filter(F.col(label) != -1).select(F.col(label).alias("_l"), F.posexplode("_u")).groupBy("_l", "pos").agg(F.avg("col").alias("m"))
    centres = dims.groupBy("_l").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("_c"))
    far = unit.join(centres, F.col(label) == F.col("_l"), "left").withColumn("_d", V.cosine_distance(F.col("_u"), F.col("_c")))
    limits = far.filter(F.col("_c").isNotNull()).groupBy(F.col(label).alias("_k")).agg((F.avg("_d") + t * F.stddev_pop("_d")).alias("_limit"), F.count("*").alias("_n"))
    out = far.join(limits, F.col(label) == F.col("_k"), "left")
    drop = (F.col("_n") >= 2) & (F.col("_d") > F.col("_limit"))
    return out.withColumn("kept_label", F.when(F.coalesce(drop, F.lit(False)), -1).otherwise(F.col(label))).drop("_u", "_l", "_c", "_d", "_k", "_limit", "_n")


def relabel(rows: DataFrame, label: str, order: str, bad: tuple[int, ...] = (-1,)) -> DataFrame:
    """rows with `dense_label`: labels numbered from 0 by first appearance, bad ones -1; labels are few against rows."""
    firsts = rows.filter(~F.col(label).isin(*bad)).groupBy(F.col(label).alias("_l")).agg(F.min(order).alias("_f"))
    numbered = firsts.select("_l", (F.row_number().over(W.orderBy("_f")) - 1).alias("_n"))
    return rows.join(numbered, F.col(label) == F.col("_l"), "left").withColumn("dense_label", F.coalesce("_n", F.lit(-1)).cast("long")).drop("_l", "_n")


def coordinate_outliers(rows: DataFrame, columns: list[str], t: float = 2.2) -> DataFrame:
    """rows with `inside`: every coordinate within t population standard deviations of its mean."""
    stats = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    inside = F.lit(True)
    for c in columns:
        inside = inside & (F.abs(F.col(c) - F.col(f"_m_{c}")) <= t * F.col(f"_s_{c}"))
    return rows.join(F.broadcast(stats), F.lit(True)).withColumn("inside", inside).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def mmr(relevance: list[float], vectors: list[list[float]], n: int, diversity: float = 0.4) -> list[int]:
    """Maximal marginal relevance (Carbonell and Goldstein, 1998): indices in the order picked."""
    v = np.asarray(vectors, float)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    left, picked = list(range(len(relevance))), []
    while left and len(picked) < n:
        redundant = (v[left] @ v[picked].T).max(axis=1) if picked else np.zeros(len(left))
        score = (1 - diversity) * np.asarray(relevance)[left] - diversity * redundant
        picked.append(left.pop(int(np.argmax(score))))
    return picked


def mmr_by_group(candidates: DataFrame, group: str, key: str, relevance: str, vector: str, n: int, diversity: float = 0.4) -> DataFrame:
    """(group, key, pick): the n picks of each group out of all its candidates, as mmr has them with candidates in order of
    relevance and key; keys are unique in a group.

    A round scores every row that is left against its group's picks and takes the best a group, so only picks are gathered.
    """
    rows = candidates.select(F.col(group).alias("_g"), F.col(key).alias("_key"), F.coalesce(F.col(relevance).cast("double"), F.lit(float("-inf"))).alias("_rel"), V.normalised(F.col(vector)).alias("_u"))
    this = F.struct(F.col("_key").alias("key"), F.col("_u").alias("unit"))

    first = F.struct((-F.col("_rel")).alias("r"), F.col("_key").alias("k"))
    picks = rows.groupBy("_g").agg(F.min_by(this, first).alias("_best")).select("_g", F.array("_best").alias("_picks"))
    for _ in range(n - 1):
        joined = rows.join(picks.withColumnRenamed("_g", "_pg"), F.col("_g").eqNullSafe(F.col("_pg")))
        closest = F.array_max(F.transform("_picks", lambda p: V.dot(p["unit"], F.col("_u"))))
        picked = F.exists("_picks", lambda p: p["key"].eqNullSafe(F.col("_key")))
        score = F.coalesce((1 - diversity) * F.col("_rel") - diversity * closest, F.lit(float("-inf")))
        # a picked row stays as one without a score, so that a group with nothing left keeps its picks
        kept = joined.withColumn("_s", score).withColumn("_left", ~picked)
        order = F.struct((-F.col("_s")).alias("s"), (-F.col("_rel")).alias("r"), F.col("_key").alias("k"))
        best = kept.groupBy("_g").agg(F.min_by(this, F.when(F.col("_left"), order)).alias("_best"), F.first("_picks").alias("_before"))
        picks = best.select("_g", F.when(F.col("_best").isNull(), F.col("_before")).otherwise(F.concat("_before", F.array("_best"))).alias("_picks"))
    return picks.select(F.col("_g").alias(group), F.posexplode("_picks").alias("_i", "_p")).select(group, F.col("_p.key").alias(key), (F.col("_i") + 1).cast("long").alias("pick"))
