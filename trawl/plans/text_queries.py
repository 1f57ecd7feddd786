"""Text queries: chunks, filters, TF-IDF, BM25, keywords, prompts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import text as X
from trawl.operators import models as M
from trawl.operators import sentences as SE
from trawl.operators import textstats as S
from trawl.registry import REGISTRY
from trawl.schema import table
from trawl.scratch import bounded_batches

Q = REGISTRY.query
TOKEN_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


@Q("fixed_chunks", "F18", "SELECT doc_id, i AS chunk_no, substr(text, CAST(i * 50 + 1 AS BIGINT), 50) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 50.0) AS BIGINT))) AS i FROM documents)")
def fixed_chunks(spark, sf):
    chunks = table(spark, sf, "documents").select("doc_id", F.posexplode(X.fixed_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return chunks.withColumn("chunk_no", F.col("chunk_no").cast("long"))


#: Sentences one after another: each opens a chunk or joins the last one, by the words so far.
CHUNKS_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS sentence FROM t),
w AS MATERIALIZED (SELECT doc_id, i, sentence, len(regexp_extract_all(sentence, '[^ \t\n\x0B\f\r]+')) AS n FROM s),
r AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS chunk_no, n FROM w WHERE i = 1
  UNION ALL SELECT w.doc_id, w.i, CASE WHEN r.n + w.n > 128 THEN r.chunk_no + 1 ELSE r.chunk_no END, CASE WHEN r.n + w.n > 128 THEN w.n ELSE r.n + w.n END FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1)
SELECT r.doc_id, r.chunk_no, string_agg(w.sentence, ' ' ORDER BY r.i) AS chunk FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i GROUP BY 1, 2
"""


@Q("sentence_chunks", "F19", CHUNKS_SQL)
def sentence_chunks(spark, sf):
    bounded_batches(spark)
    chunks = table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentence_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return chunks.withColumn("chunk_no", F.col("chunk_no").cast("long"))


@Q("metadata_sentence", "F16", """
WITH m AS (SELECT user_id, list_sort(list_distinct(list(replace(event_type, '_', ' ')))) AS t FROM events GROUP BY 1)
SELECT user_id, 'Naslovi: ' || array_to_string(t, '. ') || '. Ključne besede: ' || array_to_string(t, ', ') || '.' AS sentence FROM m
""")
def metadata_sentence(spark, sf):
    lists = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return lists.select("user_id", X.metadata_sentence(F.col("t"), F.array().cast("array<string>"), F.col("t")).alias("sentence"))


@Q("blacklist_filter", "F14", "SELECT doc_id, contains(lower(trim(text)), 'license') OR contains(lower(trim(text)), 'password') AS bad FROM documents")
def blacklist_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.contains_any(F.col("text"), ("license", "password")).alias("bad"))


@Q("tfidf_text", "F15", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ' ' || source ELSE ' ' || text END AS corpus_text FROM documents")
def tfidf_text(spark, sf):
    summary = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return table(spark, sf, "documents").select("doc_id", X.tfidf_text(F.col("lang"), summary, F.col("text")).alias("corpus_text"))


@Q("clean_words", "F20 F17", "SELECT doc_id, regexp_replace(lower(text), '[!\"#$%&''()*+,./:;<=>?@\\[\\\\\\]^_`{|}~-]', '', 'g') AS plain FROM documents")
def clean_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.plain(F.col("text")).alias("plain"))


@Q("stop_word_filter", "F17", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")), ' ') AS words FROM documents")
def stop_word_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.content_words(F.col("text")), " ").alias("words"))


@Q("lemma_words", "F17", "SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+|\\p{L}+|[^\\p{L}\\p{N}_\\s]'), lambda w: regexp_matches(w, '^\\p{L}{2,}$') AND lower(left(w, 1)) = left(w, 1)), lambda w: lower(w)), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")), ' ') AS words FROM documents")
def lemma_words(spark, sf):
    """The lemma pipeline with its stand-in analyser: parts of speech, lemmas, stop words."""
    bounded_batches(spark)
    return table(spark, sf, "documents").select("doc_id", M.lemma_column(F.col("text"), M.SurfaceAnalyser(), X.STOP_WORDS).alias("words"))


@Q("lemma_blacklist", "F34", "SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '' AND w NOT IN ('prvi niz', 'drugi niz', 'tretji niz', 'as', 'blok')), ' ') AS words FROM benchmark")
def lemma_blacklist(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.drop_lemmas(F.col("text")).alias("words"))


@Q("grading_prompt", "F24", "SELECT conv_id, array_to_string(list('[' || CAST(n AS VARCHAR) || '] ' || left(text, 2000) ORDER BY n), chr(10) || chr(10)) AS passages FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def grading_prompt(spark, sf):
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return lists.select("conv_id", X.numbered_passages(F.transform("l", lambda s: s["text"])).alias("passages"))


@Q("rag_prompt", "F25", "SELECT item_id, 'Answer the following question using context.' || chr(10) || 'Context: ' || text || chr(10) || 'Question: ' || text AS prompt FROM benchmark")
def rag_prompt(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.rag_prompt(F.col("text"), F.col("text")).alias("prompt"))


@Q("preview_text", "F22 F23", "SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS preview, translate(left(text, 60), ' /\\', '___') AS folder FROM documents")
def preview_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"), X.folder_name(F.col("text")).alias("folder"))


@Q("keyword_hits", "F21", "SELECT doc_id, CAST(contains(text, 'the') AS BIGINT) + CAST(contains(text, 'und') AS BIGINT) + CAST(contains(text, 'que') AS BIGINT) AS hits FROM documents")
def keyword_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.keyword_hits(F.col("text"), ("the", "und", "que")).alias("hits"))


CLASSES = (("the",), ("und",), ("que",), ("les", "des"), ("ing",))


@Q("keyword_class", "A16", """
WITH p AS (SELECT doc_id, lower(text) AS t FROM documents),
c AS (SELECT doc_id, (length(t) - length(replace(t, 'the', ''))) // 3 AS a, (length(t) - length(replace(t, 'und', ''))) // 3 AS b, (length(t) - length(replace(t, 'que', ''))) // 3 AS c,
  (length(t) - length(replace(t, 'les', ''))) // 3 + (length(t) - length(replace(t, 'des', ''))) // 3 AS d, (length(t) - length(replace(t, 'ing', ''))) // 3 AS e FROM p)
SELECT doc_id, CAST(CASE greatest(a, b, c, d, e) WHEN 0 THEN 0 WHEN a THEN 1 WHEN b THEN 2 WHEN c THEN 3 WHEN d THEN 4 ELSE 5 END AS BIGINT) AS class FROM c
""")
def keyword_class(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.keyword_class(F.lower("text"), CLASSES).alias("class"))


@Q("curve_labels", "F32", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_nationkey <> 3 THEN 'm' || CAST(s_nationkey AS VARCHAR) || ' + r' || CAST(s_nationkey AS VARCHAR) ELSE 'm' || CAST(s_nationkey AS VARCHAR) END || ' - my file distance' AS label, CAST(split_part('ndcg@' || CAST(s_suppkey AS VARCHAR), '@', 2) AS INTEGER) AS k FROM supplier")
def curve_labels(spark, sf):
    rows = table(spark, sf, "supplier")
    name = lambda p: F.concat(F.lit(p), F.col("s_nationkey").cast("string"))
    label = X.curve_label(name("m"), F.col("s_suppkey") % 2 == 0, F.when(F.col("s_nationkey") != 3, name("r")), F.lit("my_file.json"))
    key = F.concat(F.lit("ndcg@"), F.col("s_suppkey").cast("string"))
    return rows.select("s_suppkey", label.alias("label"), F.split_part(key, F.lit("@"), F.lit(2)).cast("int").alias("k"))


@Q("bow_priority", "V8", f"""
WITH t AS (SELECT item_id, {TOKEN_SQL} AS w FROM benchmark), q AS (SELECT w AS qw FROM t WHERE item_id = (SELECT min(item_id) FROM t)),
p AS (SELECT item_id, w, qw FROM t, q),
c AS (SELECT item_id, list_transform(list_distinct(w), lambda x: CAST(len(list_filter(w, lambda y: y = x)) AS DOUBLE)) AS a, list_transform(list_distinct(qw), lambda x: CAST(len(list_filter(qw, lambda y: y = x)) AS DOUBLE)) AS b,
  list_sum(list_transform(list_distinct(w), lambda x: CAST(len(list_filter(w, lambda y: y = x)) * len(list_filter(qw, lambda y: y = x)) AS DOUBLE))) AS d FROM p)
SELECT item_id, round(d / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))), 6) AS cosine FROM c
""")
def bow_priority(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", X.tokens(F.col("text")).alias("w"))
    query = rows.orderBy("item_id").limit(1).select(F.col("w").alias("qw"))
    return rows.join(F.broadcast(query), F.lit(True)).select("item_id", F.round(X.bow_cosine(F.col("w"), F.col("qw")), 6).alias("cosine"))


@Q("keyword_window_priority", "V9", """
WITH p AS (SELECT page_id, url, html, strpos(lower(html), '<a ') AS a, strpos(lower(html), 'the') AS k FROM pages)
SELECT page_id, CASE WHEN contains(lower(url), 'th') THEN 0 ELSE 1 END AS in_url,
       CASE WHEN contains(substr(lower(html), CAST(greatest(a - 50, 1) AS BIGINT), 100), 'the') THEN 0 ELSE 1 END AS in_window, CASE WHEN k > 0 THEN abs(k - a) ELSE 100 END AS distance
FROM p
""")
def keyword_window_priority(spark, sf):
    low = F.lower("html")
    at, key = F.locate("<a ", low), F.locate("the", low)
    window = F.substring(low, F.greatest(at - 50, F.lit(1)), F.lit(100))
    return table(spark, sf, "pages").select(
        "page_id", F.when(F.contains(F.lower("url"), F.lit("th")), 0).otherwise(1).alias("in_url"),
        F.when(F.contains(window, F.lit("the")), 0).otherwise(1).alias("in_window"), F.when(key > 0, F.abs(key - at)).otherwise(100).cast("long").alias("distance"),
    )


WORDS_SQL = r"""
w AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: regexp_replace(regexp_replace(x, '^[("''\[«„“]+', ''), '[)"''\]»”,;:]+$', '')), lambda x: x <> '') AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS word, unnest(list_concat([''], l[1:-2])) AS before FROM w),
k AS (SELECT lower(regexp_replace(word, '\.$', '')) AS kind, CASE WHEN ends_with(word, '.') THEN 1 ELSE 0 END AS ended, before, lower(regexp_replace(before, '\.$', '')) AS previous FROM e)
"""
SHORT_SQL = "WITH " + WORDS_SQL + r"""
, c AS (SELECT kind, sum(ended) AS ended, sum(1 - ended) AS open FROM k GROUP BY kind), n AS (SELECT sum(ended) / sum(ended + open) AS p FROM c),
r AS (SELECT kind, CAST(ended AS BIGINT) AS ended, CAST(open AS BIGINT) AS open, length(kind) - length(replace(kind, '.', '')) AS inner_periods, least(greatest(p, 1e-9), 1 - 1e-9) AS p FROM c, n WHERE ended > 0 AND regexp_matches(kind, '\p{L}')),
s AS (SELECT kind, ended, open, -2 * (ended * ln(p) + open * ln(1 - p) - ended * ln(0.99) - open * ln(0.01)) * exp(-(length(kind) - inner_periods)) * (inner_periods + 1) * exp(greatest(-open * ln(length(kind) - inner_periods), -700)) AS score FROM r)
"""


@Q("abbreviation_scores", "F19", SHORT_SQL + "SELECT kind, ended, open, round(score, 6) + 0.0 AS score FROM s")
def abbreviation_scores(spark, sf):
    """How much each word of the documents looks like an abbreviation."""
    scores = SE.abbreviation_scores(SE.period_counts(table(spark, sf, "documents"), "text"))
    return scores.select("kind", "ended", "open", (F.round("score", 6) + 0.0).alias("score"))


@Q("learned_chunks", "F19", None)
def learned_chunks(spark, sf):
    """Chunks of the documents by sentences of a splitter that has learnt from all of them."""
    bounded_batches(spark)
    docs = SE.with_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text", "chunks")
    return docs.select("doc_id", F.posexplode("chunks").alias("chunk_no", "chunk"))


@Q("tfidf_terms", "V10", f"""
WITH w AS (SELECT item_id, unnest({TOKEN_SQL}) AS term FROM benchmark), c AS (SELECT item_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
v AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM c GROUP BY 1 ORDER BY cf DESC, term LIMIT 200),
r AS (SELECT item_id, c.term, tf * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1.0) AS x FROM c JOIN v ON v.term = c.term)
SELECT item_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS weight FROM r
""")
def tfidf_terms(spark, sf):
    docs = table(spark, sf, "benchmark")
    found = S.tfidf(S.term_counts(docs, "item_id", "text"), "item_id", docs.count(), 200)
    return found.select("item_id", "term", F.round("weight", 6).alias("weight"))


BM25_SQL = f"""
WITH w AS (SELECT doc_id, unnest({TOKEN_SQL}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
l AS (SELECT doc_id, sum(tf) AS len FROM c GROUP BY 1), s AS (SELECT count(*) AS n, avg(len) AS a FROM l),
q AS (SELECT DISTINCT item_id, unnest({TOKEN_SQL}) AS term FROM benchmark), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
b AS (SELECT q.item_id, c.doc_id, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1.0 - 0.75 + 0.75 * len / a))) AS score
  FROM q JOIN c ON c.term = q.term JOIN d ON d.term = q.term JOIN l ON l.doc_id = c.doc_id CROSS JOIN s GROUP BY 1, 2)
"""


def _bm25(spark, sf, best=None):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    return S.bm25(table(spark, sf, "documents"), asked, "doc_id", "text", "item_id", best)


@Q("bm25_scores", "V13", BM25_SQL + "SELECT item_id, doc_id, round(score, 5) AS score FROM b")
def bm25_scores(spark, sf):
    return _bm25(spark, sf).select("item_id", "doc_id", F.round("score", 5).alias("score"))


@Q("bm25_top10", "O8", BM25_SQL + "SELECT item_id, doc_id, score_rank FROM (SELECT item_id, doc_id, rank() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC) AS score_rank FROM b) WHERE score_rank <= 10")
def bm25_top10(spark, sf):
    best = W.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)))
    return _bm25(spark, sf, 10).withColumn("score_rank", F.rank().over(best).cast("long")).filter("score_rank <= 10").select("item_id", "doc_id", "score_rank")


@Q("cluster_docs", "A17", "SELECT role, md5(string_agg(text, ' ' ORDER BY conv_id * 1000 + turn)) AS digest, count(*) AS size FROM conversations GROUP BY role")
def cluster_docs(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn")).filter(F.col("text").isNotNull())
    sizes = rows.groupBy("role").agg(F.count("*").alias("size"))
    joined = S.cluster_docs(rows, "role", "key", "text")
    return joined.join(sizes, "role").select("role", F.md5(F.encode("cluster_text", "utf-8")).alias("digest"), "size")


@Q("cluster_keywords", "V11", None)
def cluster_keywords(spark, sf):
    bounded_batches(spark)
    docs = table(spark, sf, "documents").withColumn("label", F.pmod(F.hash("lang"), F.lit(97)))
    clusters = docs.select("label").distinct().count()
    return S.cluster_keywords(S.keyword_term_counts(docs, "label", "text", clusters), "label", clusters)
