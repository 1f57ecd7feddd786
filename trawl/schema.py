"""Schemas of the crawl store and loaders of its tables, real ones and relational surrogates over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The crawl store. `priority` keeps the store's decimal(6,5).
STORE = {
    "site": "id int, domain string, robots_content string, sitemap_content string",
    "page": "id int, site_id int, page_type_code string, url string, html_content string, http_status_code int, accessed_time timestamp, content_hash string, priority decimal(6,5)",
    "page_data": "id int, page_id int, data_type_code string, data binary",
    "image": "id int, page_id int, filename string, content_type string, data binary, accessed_time timestamp",
    "link": "from_page int, to_page int",
    "model": "id int, model_name string",
    "segment": "id int, page_id int, model_id int, page_segment string, embedding array<float>",
}
#: The code lists.
PAGE_TYPES = ("HTML", "BINARY", "DUPLICATE", "FRONTIER")
DATA_TYPES = ("PDF", "DOC", "DOCX", "PPT", "PPTX")
#: Vector lengths that the segment store takes.
VECTOR_SIZES = (384, 768, 1024)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """page, image and link in the relational shape of the store: orders, and their lines as images and as links."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("o_orderstatus") == "F", "HTML").when(F.col("o_orderstatus") == "O", "FRONTIER").otherwise("DUPLICATE")
    return {
        "page": orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("site_id"), kind.alias("page_type_code"), F.concat(F.lit("https://example.org/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderdate").alias("accessed_time")),
        "image": lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("page_id"), F.col("l_shipmode" if "l_shipmode" in lines.columns else "l_returnflag").alias("content_type")),
        "link": lines.select(F.col("l_orderkey").alias("from_page"), F.col("l_partkey").alias("to_page")),
        "page_data": lines.select(F.col("l_orderkey").alias("page_id"), F.col("l_returnflag").alias("data_type_code")),
    }


def spark_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(STORE[name])
