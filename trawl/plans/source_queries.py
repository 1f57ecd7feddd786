"""Round trips through the file formats."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import functions as F

from trawl.registry import REGISTRY
from trawl.schema import table
from trawl.scratch import fresh_path, hand_out
from trawl.sources import files, sqldump
from trawl.sources.cache import cached

Q = REGISTRY.query


def _root(spark) -> str:
    return hand_out(spark, fresh_path(spark, "files"))


@Q("csv_log_roundtrip", "S7 K8", "SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) AS link_count, l_quantity AS fetch_time FROM lineitem")
def csv_log_roundtrip(spark, sf):
    path = _root(spark)
    files.write_log(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("link_count"), F.col("l_quantity").alias("fetch_time")), path)
    return files.read_log(spark, path, "page_id long, link_count long, fetch_time double")


@Q("page_csv_roundtrip", "S6", "SELECT page_id, url, md5(html) AS digest FROM pages")
def page_csv_roundtrip(spark, sf):
    path = _root(spark)
    table(spark, sf, "pages").select("page_id", "url", "html").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_page_csv(spark, path, "page_id long, url string, html string").select("page_id", "url", F.md5(F.encode("html", "utf-8")).alias("digest"))


@Q("article_jsonl_roundtrip", "S8", "SELECT doc_id AS id, lang AS title, md5(text) AS digest FROM documents")
def article_jsonl_roundtrip(spark, sf):
    path = _root(spark)
    docs = table(spark, sf, "documents")
    files.write_articles(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("url"), F.col("lang").alias("title"), F.lit(None).cast("string").alias("summary"), F.col("text").alias("body")), path)
    return files.read_articles(spark, path).select("id", "title", F.md5(F.encode("body", "utf-8")).alias("digest"))


@Q("json_results_scan", "S10 K10 A14", "SELECT s_nationkey AS k, round(avg(s_acctbal), 4) AS mean_ndcg FROM supplier GROUP BY 1")
def json_results_scan(spark, sf):
    path = _root(spark)
    curves = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("v"))
    named = curves.select(F.lit("m").alias("embedding_model"), F.lit(False).alias("reranking_enabled"), F.create_map(F.concat(F.lit("ndcg@"), F.col("s_nationkey").cast("string")), F.col("v")).alias("average_results"))
    named.write.json(path)
    # written as JSON lines; each line is one evaluation
    raw = spark.read.schema("average_results map<string, double>").json(path).select(F.explode("average_results").alias("key", "v"))
    return raw.groupBy(F.split_part("key", F.lit("@"), F.lit(2)).cast("int").alias("k")).agg(F.round(F.avg("v"), 4).alias("mean_ndcg"))


@Q("id_list_source", "S9", "SELECT CAST(item_id AS VARCHAR) AS id FROM benchmark")
def id_list_source(spark, sf):
    path = _root(spark)
    table(spark, sf, "benchmark").select(F.concat(F.lit("  "), F.col("item_id").cast("string"), F.lit(" ")).alias("value")).write.text(path)
    return files.read_ids(spark, path)


@Q("settings", "S14", "SELECT * FROM (VALUES ('schema', ''), ('page_table', 'pages'), ('chunk_words', '64'), ('batch_size', '32'), ('metric', 'l2'), ('return_n', '100'), ('rerank_n', '10'), ('rerank', 'True')) v(name, value)")
def settings(spark, sf):
    """Settings from a mapping such as the environment, with defaults for the rest."""
    found = asdict(files.Settings.of({"PAGE_TABLE": "pages", "CHUNK_WORDS": "64", "METRIC": "l2", "RERANK": "TRUE"}))
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "name string, value string")


@Q("cached_counts", "K9", "SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def cached_counts(spark, sf):
    """A result kept by its parameters: made once, read the second time."""
    root, made = _root(spark), []

    def make():
        made.append(1)
        return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("events"))

    for _ in range(2):
        kept = cached(spark, root, "counts", {"by": "event_type"}, make)
    if len(made) != 1:
        raise AssertionError("a kept result was made again")
    return kept


@Q("migrated_tables", "S13", "SELECT page_id, length(url) AS url_length FROM pages")
def migrated_tables(spark, sf):
    """A script of statements, split at its semicolons and run in order; the last one's view is read."""
    path = f"{sf}/pages.parquet"
    first, second = (f"migrated_{k}_{uuid.uuid4().hex}" for k in "ab")
    files.migrate(spark, f"CREATE TEMP VIEW {first} AS SELECT page_id, url FROM parquet.`{path}`; CREATE TEMP VIEW {second} AS SELECT page_id, CAST(length(url) AS BIGINT) AS url_length FROM {first};")
    out = spark.table(second)
    for name in (second, first):  # out is resolved, so it does not need the names any more
        spark.catalog.dropTempView(name)
    return out


@Q("restored_pages", "S13", "SELECT page_id, url, html FROM pages")
def restored_pages(spark, sf):
    """A dump of two tables, written and read back: its pages."""
    root = _dumped(spark, sf)
    return sqldump.read_dump(spark, root, "public.pages")


@Q("restored_documents", "S13", "SELECT doc_id, lang, length(text) AS length, md5(text) AS digest FROM documents WHERE source = 'src0'")
def restored_documents(spark, sf):
    """Three columns of the documents of one source out of the dump."""
    rows = sqldump.read_dump(spark, _dumped(spark, sf), "public.documents", ("doc_id", "lang", "text", "source")).filter("source = 'src0'")
    return rows.select("doc_id", "lang", F.length("text").cast("long").alias("length"), F.md5(F.encode("text", "utf-8")).alias("digest"))


def _dumped(spark, sf):
    root = _root(spark)
    sqldump.write_dump(table(spark, sf, "pages"), f"{root}/dump", "public.pages", {"page_id": "bigint", "url": "character varying(3000)", "html": "text"})
    sqldump.write_dump(table(spark, sf, "documents"), f"{root}/dump", "public.documents", {"doc_id": "bigint", "text": "text", "lang": "text", "source": "text", "n_chars": "bigint"})
    return f"{root}/dump"
