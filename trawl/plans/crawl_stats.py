"""Crawl statistics over the store: counts, link and image degrees, sections, time slots, stage times."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import urls as U
from trawl.operators.ranking import numbered
from trawl.registry import REGISTRY
from trawl.schema import surrogate, table

Q = REGISTRY.query

PAGE_SQL = "SELECT o_orderkey AS id, o_custkey AS site_id, CASE o_orderstatus WHEN 'F' THEN 'HTML' WHEN 'O' THEN 'FRONTIER' ELSE 'DUPLICATE' END AS page_type_code, 'https://example.org/' || CAST(o_orderkey AS VARCHAR) AS url, o_orderdate AS accessed_time FROM orders"


@Q("crawl_summary", "A1 S1 J2", f"""
WITH page AS ({PAGE_SQL})
SELECT (SELECT count(DISTINCT site_id) FROM page) AS site_count,
       (SELECT count(*) FROM page) AS page_count,
       (SELECT count(*) FROM page WHERE page_type_code = 'DUPLICATE') AS duplicate_count,
       (SELECT count(*) FROM lineitem) AS image_count,
       (SELECT round(coalesce(avg(c), 0), 6) FROM (SELECT p.id, count(l.l_linenumber) AS c FROM page p LEFT JOIN lineitem l ON l.l_orderkey = p.id WHERE p.page_type_code = 'HTML' GROUP BY p.id)) AS avg_images_per_page,
       (SELECT round(coalesce(avg(c), 0), 6) FROM (SELECT p.id, count(l.l_partkey) AS c FROM page p LEFT JOIN lineitem l ON l.l_orderkey = p.id GROUP BY p.id)) AS avg_links_per_page
""")
def crawl_summary(spark, sf):
    s = surrogate(spark, sf)
    page, image, link = s["page"], s["image"], s["link"]
    # an average of counts with zeros is rows joined over pages, so each child table is only counted
    html = page.filter("page_type_code = 'HTML'")
    pages = page.agg(F.countDistinct("site_id").alias("site_count"), F.count("*").alias("page_count"), F.count_if(F.col("page_type_code") == "DUPLICATE").alias("duplicate_count"), F.count_if(F.col("page_type_code") == "HTML").alias("_html"))
    images = image.agg(F.count("*").alias("image_count"))
    on_html = image.join(html, image["page_id"] == html["id"], "left_semi").agg(F.count("id").alias("_images"))
    out_links = link.join(page, link["from_page"] == page["id"], "left_semi").agg(F.count("to_page").alias("_links"))
    one = pages.crossJoin(images).crossJoin(on_html).crossJoin(out_links)
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return one.select("site_count", "page_count", "duplicate_count", "image_count", ratio("_images", "_html").alias("avg_images_per_page"), ratio("_links", "page_count").alias("avg_links_per_page"))


def _degree(page, child, key, name):
    counted = child.groupBy(F.col(key).alias("_id")).agg(F.count("*").alias("_n"))
    joined = page.join(counted, F.col("id") == F.col("_id"), "left")
    return joined.select("id", "url", F.coalesce("_n", F.lit(0)).cast("long").alias(name)).orderBy(F.desc(name), "id")


@Q("pages_by_links", "A2 J2 O1", f"WITH page AS ({PAGE_SQL}) SELECT p.id, p.url, count(l.l_partkey) AS link_count FROM page p LEFT JOIN lineitem l ON l.l_orderkey = p.id GROUP BY p.id, p.url ORDER BY link_count DESC, p.id")
def pages_by_links(spark, sf):
    s = surrogate(spark, sf)
    return _degree(s["page"], s["link"], "from_page", "link_count")


@Q("pages_by_images", "A3 J2 O1", f"WITH page AS ({PAGE_SQL}) SELECT p.id, p.url, count(l.l_linenumber) AS image_count FROM page p LEFT JOIN lineitem l ON l.l_orderkey = p.id GROUP BY p.id, p.url ORDER BY image_count DESC, p.id")
def pages_by_images(spark, sf):
    s = surrogate(spark, sf)
    return _degree(s["page"], s["image"], "page_id", "image_count")


@Q("binary_docs_by_type", "A4", "SELECT l_returnflag AS data_type_code, count(*) AS binary_doc_count FROM lineitem GROUP BY 1 ORDER BY 1")
def binary_docs_by_type(spark, sf):
    return surrogate(spark, sf)["page_data"].groupBy("data_type_code").agg(F.count("*").alias("binary_doc_count")).orderBy("data_type_code")


@Q("links_with_urls", "J1", """
SELECT c.c_nationkey AS from_page, s.s_nationkey AS to_page, n1.n_name AS from_url, n2.n_name AS to_url, c.c_custkey AS link_id
FROM customer c JOIN supplier s ON s.s_suppkey = c.c_custkey JOIN nation n1 ON n1.n_nationkey = c.c_nationkey JOIN nation n2 ON n2.n_nationkey = s.s_nationkey
""")
def links_with_urls(spark, sf):
    link = table(spark, sf, "customer").join(table(spark, sf, "supplier"), F.col("c_custkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("from_page"), F.col("s_nationkey").alias("to_page"), F.col("c_custkey").alias("link_id"))
    nation = table(spark, sf, "nation")
    source = nation.select(F.col("n_nationkey").alias("_f"), F.col("n_name").alias("from_url"))
    target = nation.select(F.col("n_nationkey").alias("_t"), F.col("n_name").alias("to_url"))
    return link.join(source, F.col("from_page") == F.col("_f")).join(target, F.col("to_page") == F.col("_t")).select("from_page", "to_page", "from_url", "to_url", "link_id")


LINKS_SQL = r"""
WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages),
links AS (SELECT page_id, url, href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS target FROM h)
"""


@Q("section_link_matrix", "A9", LINKS_SQL + r"""
, s AS (SELECT page_id, split_part(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', 2) AS a, split_part(href, '/', 2) AS b FROM links)
SELECT CASE WHEN a LIKE '%.html%' THEN 'other' ELSE a END AS section_from, CASE WHEN b LIKE '%.html%' THEN 'other' ELSE b END AS section_to,
       count(*) AS links, count(DISTINCT page_id) AS pages
FROM s GROUP BY 1, 2
""")
def section_link_matrix(spark, sf):
    pages = table(spark, sf, "pages")
    links = pages.select("page_id", "url", F.explode(U.hrefs(F.col("html"))).alias("href"))
    name = lambda c: F.when(F.contains(c, F.lit(".html")), "other").otherwise(c)
    named = links.select("page_id", name(F.coalesce(U.section(F.col("url")), F.lit(""))).alias("section_from"), name(F.coalesce(F.try_element_at(F.split("href", "/"), F.lit(2)), F.lit(""))).alias("section_to"))
    return named.groupBy("section_from", "section_to").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@Q("section_pages", "A9", r"""
WITH s AS (SELECT page_id, split_part(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', 2) AS a FROM pages)
SELECT page_id, section, count(*) OVER (PARTITION BY section) AS section_size, row_number() OVER (PARTITION BY section ORDER BY page_id) - 1 AS section_index
FROM (SELECT page_id, CASE WHEN a LIKE '%.html%' THEN 'other' ELSE a END AS section FROM s)
""")
def section_pages(spark, sf):
    section = F.coalesce(U.section(F.col("url")), F.lit(""))
    named = table(spark, sf, "pages").select("page_id", F.when(F.contains(section, F.lit(".html")), "other").otherwise(section).alias("section"))
    found = numbered(named, "section", "page_id", F.floor(F.col("page_id") / 4096), "section_index")
    return found.select("page_id", "section", F.col("group_size").alias("section_size"), "section_index")


SLOT = 30


def global_numbers(df, order: list[str]):
    """df with `_rn`, its row number by order, whose first column is a time, without one task that sees all rows.

    Rows are numbered within each hour; only one count an hour is summed up over all.
    """
    hourly = df.withColumn("_hour", F.date_trunc("hour", order[0]))
    local = hourly.withColumn("_local", F.row_number().over(W.partitionBy("_hour").orderBy(*order)))
    sizes = hourly.groupBy(F.col("_hour").alias("_h")).agg(F.count("*").alias("_size"))
    before = sizes.select("_h", (F.sum("_size").over(W.orderBy("_h")) - F.col("_size")).alias("_before"))
    return local.join(before, F.col("_hour").eqNullSafe(F.col("_h"))).withColumn("_rn", F.col("_local") + F.col("_before")).drop("_hour", "_local", "_h", "_before")


@Q("section_slots", "W2 P9", f"""
WITH r AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE ts IS NOT NULL),
s AS (SELECT event_type AS section, CAST((rn - 1) // {SLOT} AS BIGINT) AS slot FROM r),
c AS (SELECT slot, section, count(*) AS n FROM s GROUP BY 1, 2),
k AS (SELECT DISTINCT section FROM s), t AS (SELECT slot, count(*) AS total FROM s GROUP BY 1)
SELECT t.slot, k.section, coalesce(c.n, 0) AS pages, round(100.0 * coalesce(c.n, 0) / t.total, 6) AS share
FROM t CROSS JOIN k LEFT JOIN c ON c.slot = t.slot AND c.section = k.section
""")
def section_slots(spark, sf):
    rows = global_numbers(table(spark, sf, "events").filter(F.col("ts").isNotNull()).select("ts", "event_id", "event_type"), ["ts", "event_id"])
    slotted = rows.select(F.floor((F.col("_rn") - 1) / SLOT).cast("long").alias("slot"), F.col("event_type").alias("section"))
    counts = slotted.groupBy("slot", "section").agg(F.count("*").alias("n"))
    # absent sections get zero: each slot's few counts become a map that is read with the section list
    sections = F.broadcast(counts.select("section").distinct().agg(F.sort_array(F.collect_set("section")).alias("_sections")))
    slots = counts.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("section", "n"))).alias("_n"), F.sum("n").alias("_total"))
    full = slots.join(sections, F.lit(True)).select("slot", "_n", "_total", F.explode("_sections").alias("section"))
    own = F.coalesce(F.try_element_at("_n", F.col("section")), F.lit(0)).cast("long")
    return full.select("slot", "section", own.alias("pages"), F.round(100.0 * own / F.col("_total"), 6).alias("share"))


@Q("running_pages", "W1", f"""
WITH r AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS rn FROM events)
SELECT slot, n AS pages, CAST(sum(n) OVER (ORDER BY slot) AS BIGINT) AS running FROM (SELECT CAST((rn - 1) // {SLOT} AS BIGINT) AS slot, count(*) AS n FROM r GROUP BY 1)
""")
def running_pages(spark, sf):
    rows = global_numbers(table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"])
    slots = rows.groupBy(F.floor((F.col("_rn") - 1) / SLOT).cast("long").alias("slot")).agg(F.count("*").alias("pages"), F.max("_rn").alias("running"))
    return slots.select("slot", "pages", F.col("running").cast("long").alias("running"))


@Q("progress_marks", "A21", "SELECT event_id, rn AS pages FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) WHERE rn % 25 = 0")
def progress_marks(spark, sf):
    rows = global_numbers(table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"])
    return rows.filter(F.col("_rn") % 25 == 0).select("event_id", F.col("_rn").cast("long").alias("pages"))


@Q("stage_time_means", "A8", """
SELECT round(avg(l_quantity), 6) AS fetch_mean, round(avg(l_extendedprice), 6) AS save_mean, round(avg(l_discount), 6) AS parse_mean, round(avg(l_tax), 6) AS score_mean,
       round(avg(l_extendedprice / nullif(l_quantity, 0)), 6) AS score_per_link, round(avg(l_quantity + l_extendedprice + l_discount + l_tax), 6) AS total_mean
FROM lineitem
""")
def stage_time_means(spark, sf):
    rows = table(spark, sf, "lineitem")
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    total = F.col("l_quantity") + F.col("l_extendedprice") + F.col("l_discount") + F.col("l_tax")
    # a page without links has no ratio: null, which the mean skips
    return rows.agg(mean("l_quantity", "fetch_mean"), mean("l_extendedprice", "save_mean"), mean("l_discount", "parse_mean"), mean("l_tax", "score_mean"), mean(F.try_divide("l_extendedprice", "l_quantity"), "score_per_link"), mean(total, "total_mean"))


@Q("cluster_share", "A10 A11", "SELECT count(*) FILTER (label IN (1, 3, 5)) AS selected, count(*) AS total, round(avg(CASE WHEN label IN (1, 3, 5) THEN 1.0 ELSE 0.0 END), 6) AS ratio, round(avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise FROM embeddings")
def cluster_share(spark, sf):
    rows, chosen = table(spark, sf, "embeddings"), F.col("label").isin(1, 3, 5)
    return rows.agg(F.count_if(chosen).alias("selected"), F.count("*").alias("total"), F.round(F.avg(F.when(chosen, 1.0).otherwise(0.0)), 6).alias("ratio"), F.round(F.avg(F.when(F.col("label") == -1, 1.0).otherwise(0.0)), 6).alias("noise"))


@Q("cluster_extent", "A12", """
WITH p AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT label, count(*) AS size, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(min(x) - 0.05 * (max(x) - min(x)), 6) AS x_from, round(max(x) + 0.05 * (max(x) - min(x)), 6) AS x_to
FROM p WHERE label <> -1 GROUP BY label HAVING count(*) >= 2
""")
def cluster_extent(spark, sf):
    p = table(spark, sf, "embeddings").filter("label <> -1").select("label", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    pad = 0.05 * (F.max("x") - F.min("x"))
    grouped = p.groupBy("label").agg(F.count("*").alias("size"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"), F.round(F.min("x") - pad, 6).alias("x_from"), F.round(F.max("x") + pad, 6).alias("x_to"))
    return grouped.filter("size >= 2")
