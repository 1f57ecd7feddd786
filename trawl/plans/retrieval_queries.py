"""The end-to-end pipelines: pages to an index of segments, and a query string to ranked segments, grades and a prompt."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions import html as H
from trawl.functions import text as X
from trawl.functions import vectors as V
from trawl.operators import models as M
from trawl.operators import pivots as P
from trawl.operators import ranking as R
from trawl.registry import REGISTRY
from trawl.schema import table
from trawl.scratch import bounded_batches, materialise

Q = REGISTRY.query
MODEL = M.HashedEmbedder(384)


def chunks(spark, sf):
    """(id, page_id, segment_no, page_segment) of all pages; parsing and chunking stay in one stage."""
    bounded_batches(spark)
    parsed = table(spark, sf, "pages").filter(F.col("html").isNotNull() & (F.col("html") != "")).select("page_id", H.cleaned_column(F.col("html")).alias("a"))
    text = F.concat(F.coalesce("a.title", F.lit("")), F.lit(". "), F.col("a.body"))
    found = parsed.select("page_id", F.posexplode(X.sentence_chunks(text)).alias("segment_no", "page_segment"))
    # a number of the page's own up to 2^32 segments, whatever the page's number
    return found.withColumn("id", F.shiftleft(F.col("page_id"), 32) + F.col("segment_no"))


def segments(spark, sf):
    """(id, page_id, segment_no, page_segment, embedding) of all pages."""
    return embedded(chunks(spark, sf))


def embedded(rows):
    return rows.withColumn("embedding", M.embed_column(F.col("page_segment"), MODEL))


def questions(spark, sf):
    """(id, query, embedding): every item of benchmark asks with its whole text."""
    rows = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("query"))
    return rows.withColumn("embedding", M.embed_column(F.col("query"), MODEL))


def retrieve(spark, sf, candidates: int = 100, n: int = 10):
    """The n best segments for each question: its nearest by cosine, then reranked."""
    V.check_size([0.0] * MODEL.size)
    # texts are written, vectors only where the questions are too many to meet the segments as these are embedded
    rows, asked = materialise(chunks(spark, sf), "segments"), materialise(questions(spark, sf), "questions")
    near = P.nearest_of_few(asked, embedded(rows), candidates)
    if near is None:
        near = P.nearest_by_pivots(asked, embedded(rows), candidates)
    told = near.join(rows.select("id", "page_id", "page_segment"), "id").join(asked.select(F.col("id").alias("query_id"), "query"), "query_id")
    scored = told.withColumn("cross", M.rerank_column(F.col("query"), F.col("page_segment"), M.OverlapReranker()))
    return R.rerank(scored, "cross", "rank", n, by="query_id")


@Q("index_segments", "V3 V4 K4 F19", None)
def index_segments(spark, sf):
    return segments(spark, sf).select("page_id", "segment_no", "page_segment", F.size("embedding").alias("size"), F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@Q("retrieve_reranked", "V2 V6 W5 O3", None)
def retrieve_reranked(spark, sf):
    return retrieve(spark, sf).select("query_id", "new_rank", "id", "page_id", "page_segment", F.round("distance", 6).alias("distance"), F.round("cross", 6).alias("cross"))


@Q("graded_retrieval", "V16 V14", None)
def graded_retrieval(spark, sf):
    graded = retrieve(spark, sf).withColumn("grade", M.grade_column(F.col("query"), F.col("page_segment"), M.OverlapGrader()))
    return R.ndcg(graded.withColumn("gain", F.pow(F.lit(2.0), F.col("grade")) - 1), "query_id", "cross", "gain", 10)


@Q("rag_answer", "V16 F25", None)
def rag_answer(spark, sf):
    best = retrieve(spark, sf, n=3).groupBy("query_id", "query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("new_rank", "page_segment"))), lambda s: s["page_segment"]), "\n").alias("context"))
    return best.select("query_id", M.answer_column(X.rag_prompt(F.col("context"), F.col("query")), M.TemplateGenerator()).alias("answer"))
