"""Clustering and projection queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions import vectors as V
from trawl.operators import blocks as K
from trawl.operators import clustering as C
from trawl.operators import layout as L
from trawl.operators import lsa as A
from trawl.registry import REGISTRY
from trawl.schema import table
from trawl.scratch import materialise

Q = REGISTRY.query
#: The numbers of clusters that the reference scans.
SCAN = range(35, 45)
#: Terms and dimensions of the reference's decomposition, and the shape of its layout.
TERMS, DIMENSIONS = 15_000, 40
MIN_DIST, SPREAD = 0.8, 0.99

U_SQL = "WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS r FROM embeddings), u AS (SELECT id, label, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM e) "


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


@Q("cluster_outliers", "W9", U_SQL + """
, m AS (SELECT label, i, avg(v[i]) AS m FROM u, (SELECT unnest(range(1, 65)) AS i) WHERE label <> -1 GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1),
d AS (SELECT id, u.label, 1.0 - list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))) AS d FROM u JOIN c ON c.label = u.label),
s AS (SELECT id, label, d, avg(d) OVER (PARTITION BY label) + 2.0 * stddev_pop(d) OVER (PARTITION BY label) AS cut, count(*) OVER (PARTITION BY label) AS n FROM d)
SELECT id, CASE WHEN n >= 2 AND d > cut THEN -1 ELSE label END AS kept_label FROM s
""")
def cluster_outliers(spark, sf):
    return C.outliers(vectors(spark, sf), "label", "embedding").select("id", "kept_label")


@Q("relabel_clusters", "W8", "WITH f AS (SELECT label, min(vec_id) AS p FROM embeddings WHERE label <> 3 GROUP BY 1), n AS (SELECT label, row_number() OVER (ORDER BY p) - 1 AS d FROM f) SELECT vec_id AS id, coalesce(n.d, -1) AS dense_label FROM embeddings e LEFT JOIN n ON n.label = e.label")
def relabel_clusters(spark, sf):
    return C.relabel(vectors(spark, sf), "label", "id", bad=(3, -1)).select("id", "dense_label")


@Q("coordinate_outliers", "P8", "WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM p) SELECT id, abs(x - mx) <= 2.2 * sx AND abs(y - my) <= 2.2 * sy AS inside FROM p, s")
def coordinate_outliers(spark, sf):
    points = vectors(spark, sf).select("id", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    return C.coordinate_outliers(points, ["x", "y"]).select("id", "inside")


@Q("cluster_silhouette", "A18", U_SQL + """
, p AS (SELECT a.id, a.label, b.label AS other, avg(1.0 - list_dot_product(a.v, b.v)) AS m FROM u a JOIN u b ON b.id <> a.id GROUP BY 1, 2, 3),
q AS (SELECT id, label, min(CASE WHEN other = label THEN m END) AS x, min(CASE WHEN other <> label THEN m END) AS y FROM p GROUP BY 1, 2)
SELECT label, round(avg(CASE WHEN x IS NULL OR y IS NULL THEN 0 ELSE (y - x) / greatest(x, y) END), 5) AS silhouette FROM q GROUP BY 1
""")
def cluster_silhouette(spark, sf):
    points = C.exact_silhouette(vectors(spark, sf), "label", "embedding")
    return points.groupBy("label").agg(F.round(F.avg("silhouette"), 5).alias("silhouette"))


@Q("kmeans_labels", "M2 M5", None)
def kmeans_labels(spark, sf):
    return C.kmeans(C.with_unit_vectors(vectors(spark, sf)), 10).select("id", "cluster")


@Q("best_k", "M3", None)
def best_k(spark, sf):
    """Mean silhouette by Euclidean distances of all pairs for each k of the reference's scan, and the first best."""
    rows = C.with_unit_vectors(vectors(spark, sf)).withColumn("unit", V.normalised(F.col("embedding"))).select("id", "features", "unit").persist()
    labelled = C.kmeans_scan(rows, list(SCAN))
    labelled = labelled.select("id", "unit", F.array(*[f"c{k}" for k in SCAN]).alias("labels")).persist()
    scores = list(zip(SCAN, K.full_silhouettes(labelled, "id", "unit", "labels", list(SCAN)), strict=True))
    labelled.unpersist()
    rows.unpersist()
    best = C.first_best(scores)
    return spark.createDataFrame([(k, s, k == best) for k, s in scores], "k int, silhouette double, best boolean")


@Q("svd_variance", "M1", None)
def svd_variance(spark, sf):
    share = C.explained_variance(vectors(spark, sf).select(V.doubles(F.col("embedding")).alias("v")), "v", 10)
    return spark.createDataFrame([(10, share)], "dimensions int, explained double")


def _decomposed(spark, sf):
    """Sparse rows of the documents' terms, and their decomposition."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows, terms = A.term_space(docs, "doc_id", "text", TERMS)
    rows = materialise(rows, "terms")
    return rows, A.truncated_svd(rows, terms, DIMENSIONS, docs.count())


@Q("lsa_spectrum", "M1", None)
def lsa_spectrum(spark, sf):
    """The singular values of the documents' term matrix, and the share of the variance that all of them hold."""
    _, found = _decomposed(spark, sf)
    return spark.createDataFrame([(i, float(v), found.explained) for i, v in enumerate(found.values)], "dimension int, singular_value double, explained double")


@Q("lsa_clusters", "M1 M2 M5 V10", None)
def lsa_clusters(spark, sf):
    """The chain from terms over the decomposition to clusters: one row a document with a term of the vocabulary."""
    rows, found = _decomposed(spark, sf)
    flat = materialise(A.projected(rows, "doc_id", found.components), "projected")
    return C.kmeans(C.with_unit_vectors(flat, "vector"), SCAN[0]).select("doc_id", "cluster")


@Q("umap_layout", "M4", None)
def umap_layout(spark, sf):
    """The flat layout of all embeddings by their fuzzy neighbour graph."""
    return L.layout(vectors(spark, sf), "id", "embedding", min_dist=MIN_DIST, spread=SPREAD, epochs=40)


@Q("pca_projection", "M4", None)
def pca_projection(spark, sf):
    return C.project(C.with_unit_vectors(vectors(spark, sf))).select("id", F.get("x", 0).alias("x"), F.get("x", 1).alias("y"))


@Q("mmr_rerank", "V12", None)
def mmr_rerank(spark, sf):
    rows = vectors(spark, sf).withColumn("relevance", F.get("embedding", 0).cast("double")).withColumn("v", V.doubles(F.col("embedding")))
    return C.mmr_by_group(rows, "label", "id", "relevance", "v", 6)
