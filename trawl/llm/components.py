"""Connected components by alternating large and small stars (Kiveris et al., 2014), a written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.shared import salted_join
from trawl.scratch import Scratch, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or, for a small star, its smaller) neighbours on the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    joined = salted_join(both, least.select("u", "m"), "u", counts=least.select("u", "n"))
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (u, v): the least node that can be reached. Ends as no edge changes."""
    with Scratch(edges.sparkSession) as scratch:
        now = scratch.write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        mark = None
        while True:
            seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).first()
            if tuple(seen) == mark or not seen["n"]:
                break
            mark = tuple(seen)
            now = scratch.replace(now, _star(_star(now, True), False), "stars")
        return materialise(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "components")
