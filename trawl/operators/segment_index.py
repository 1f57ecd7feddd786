"""A vector index beside the segment table: cells around centres, made after a bulk load and dropped before the next one.

Centres are fitted on a bounded sample (SAMPLE rows, by a hash of the key); every row is in the index, in the cell of its
nearest centre by cosine. A query looks into the cells of its `probes` nearest centres and takes distances exactly there.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import vectors as V
from trawl.operators import blocks as K
from trawl.operators.clustering import with_unit_vectors
from trawl.scratch import remove

SAMPLE = 50_000
#: Rows that a cell has on average, and how many cells there are at most.
CELL_ROWS, MOST_CELLS = 500, 4096
PROBES = 12


def create(rows: DataFrame, path: str, key: str = "id", vector: str = "embedding", seed: int = 42) -> None:
    """Write the index of rows: path/centres, and path/cells partitioned by cell. Null and zero vectors are left out."""
    given = rows.filter(F.col(vector).isNotNull() & (V.norm(F.col(vector)) > 0)).select(F.col(key).alias("id"), V.doubles(F.col(vector)).alias("embedding"))
    units = with_unit_vectors(given)
    cells = max(1, min(MOST_CELLS, units.count() // CELL_ROWS))
    sample = units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    model = KMeans(k=max(2, cells), seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="features", predictionCol="cell").fit(sample)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    rows.sparkSession.createDataFrame(centres, "id long, embedding array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    model.transform(units).select("id", "embedding", "cell").repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")


def drop(spark: SparkSession, path: str) -> None:
    """Remove the index; there need not be one."""
    remove(spark, path)


def load(rows: DataFrame, table: str, index: str, key: str = "id", vector: str = "embedding") -> None:
    """Bulk load: the index goes, rows are appended to the table, and the index is made anew over the whole table."""
    spark = rows.sparkSession
    drop(spark, index)
    rows.write.mode("append").parquet(table)
    create(spark.read.parquet(table), index, key, vector)


def search(spark: SparkSession, path: str, queries: DataFrame, n: int, probes: int = PROBES, key: str = "id", vector: str = "embedding", size: int = K.BLOCK) -> DataFrame:
    """(query_id, id, distance, rank): the n nearest by cosine that the probed cells hold for each row of queries."""
    asked = queries.select(F.col(key).alias("id"), V.doubles(F.col(vector)).alias("embedding"))
    near = K.nearest_for_all(asked, spark.read.parquet(f"{path}/centres"), probes, size=size).select(F.col("query_id").alias("id"), F.col("id").cast("int").alias("cell"))
    placed = near.join(asked, "id")
    return K.nearest_within(placed, spark.read.parquet(f"{path}/cells"), "cell", n, size=size)
