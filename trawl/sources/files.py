"""File sources and sinks of the project's formats: CSV with long fields, logs, id lists, JSON lines and result files."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_page_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header, quoted line breaks and fields of any length."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path)


def write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id string): stripped lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def write_articles(rows: DataFrame, path: str) -> None:
    """Cleaned articles as JSON lines."""
    rows.write.mode("overwrite").json(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, url string, title string, summary string, body string").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, embedding_model, reranking_enabled, reranking_model, k, ndcg) of a folder of evaluation files, nulls dropped."""
    schema = "embedding_model string, reranking_enabled boolean, reranking_model string, queries array<string>, db_n int, max_k int, average_results map<string, double>"
    raw = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    curve = raw.select("file", "embedding_model", "reranking_enabled", "reranking_model", F.explode("average_results").alias("key", "ndcg")).filter("ndcg IS NOT NULL")
    return curve.withColumn("k", F.split_part("key", F.lit("@"), F.lit(2)).cast("int")).drop("key")


def curve_means(results: DataFrame) -> DataFrame:
    return results.groupBy("file").agg(F.avg("ndcg").alias("mean_ndcg")).orderBy(F.desc("mean_ndcg"), "file")


def reflect(spark: SparkSession, schema: str, name: str):
    """The schema of a stored table."""
    return spark.table(f"{schema}.{name}" if schema else name).schema


@dataclass(frozen=True)
class Settings:
    """Retrieval settings; `of` reads them from a mapping such as the environment."""

    schema: str = ""
    page_table: str = "page"
    chunk_words: int = 128
    batch_size: int = 32
    metric: str = "cosine"
    return_n: int = 100
    rerank_n: int = 10
    rerank: bool = False

    @classmethod
    def of(cls, values: dict[str, str]) -> "Settings":
        out = {}
        for f in fields(cls):
            raw = values.get(f.name.upper())
            if raw is not None:
                out[f.name] = raw.lower() == "true" if isinstance(f.default, bool) else type(f.default)(raw)
        return cls(**out)


def migrate(spark: SparkSession, script: str) -> int:
    """Run the statements of a script in order; the number run."""
    statements = [s.strip() for s in script.split(";") if s.strip()]
    for s in statements:
        spark.sql(s)
    return len(statements)


def append_segments(rows: DataFrame, path: str) -> None:
    """Bulk insert of embedded segments, a folder a model, so that a filter by model prunes files."""
    rows.write.mode("append").partitionBy("model_id").parquet(path)
