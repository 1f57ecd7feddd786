"""Queries of the page store: scans, lookups, writes and duplicate resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from trawl.functions import urls as U
from trawl.operators import store
from trawl.plans.crawl_stats import PAGE_SQL
from trawl.registry import REGISTRY
from trawl.schema import DATA_TYPES, PAGE_TYPES, surrogate, table

Q = REGISTRY.query
PAGE = f"WITH page AS ({PAGE_SQL}) "
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@Q("all_tables_count", "S1", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES))
def all_tables_count(spark, sf):
    return reduce(lambda a, b: a.unionByName(b), [table(spark, sf, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows") for t in TABLES])


@Q("page_by_id", "S2", PAGE + "SELECT id, site_id, page_type_code, url FROM page WHERE id = 7")
def page_by_id(spark, sf):
    return store.by_key(surrogate(spark, sf)["page"], id=7).select("id", "site_id", "page_type_code", "url")


@Q("link_by_key", "S2", "SELECT DISTINCT l_orderkey AS from_page, l_partkey AS to_page FROM lineitem WHERE l_orderkey = 1 AND l_partkey = (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = 1)")
def link_by_key(spark, sf):
    mine = store.by_key(surrogate(spark, sf)["link"], from_page=1)
    return mine.groupBy("from_page").agg(F.min("to_page").alias("to_page"))


@Q("site_by_domain", "S3", r"SELECT page_id, url FROM pages WHERE regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '([^.]+\.[^.]+)$', 1) = 'example.org' ORDER BY page_id LIMIT 1")
def site_by_domain(spark, sf):
    return store.first_by(table(spark, sf, "pages").select("page_id", "url"), U.registered_domain(F.col("url")) == "example.org", "page_id")


@Q("page_by_url", "S3", PAGE + "SELECT id, url FROM page WHERE url = 'https://example.org/5' ORDER BY id LIMIT 1")
def page_by_url(spark, sf):
    return store.first_by(surrogate(spark, sf)["page"].select("id", "url"), F.col("url") == "https://example.org/5", "id")


@Q("page_by_hash", "S3", "SELECT page_id, md5(html) AS content_hash FROM pages WHERE md5(html) = (SELECT md5(html) FROM pages WHERE page_id = 3) ORDER BY page_id LIMIT 1")
def page_by_hash(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.md5(F.encode("html", "utf-8")).alias("content_hash"))
    wanted = pages.filter("page_id = 3").select(F.col("content_hash").alias("_h"))
    return pages.join(F.broadcast(wanted), F.col("content_hash") == F.col("_h"), "left_semi").orderBy("page_id").limit(1)


@Q("site_id_or_minus_one", "S3b", "SELECT n.n_name AS domain, coalesce(r.r_regionkey, -1) AS site_id FROM nation n LEFT JOIN region r ON r.r_name = n.n_name UNION ALL SELECT r_name, r_regionkey FROM region")
def site_id_or_minus_one(spark, sf):
    region = table(spark, sf, "region").select(F.col("r_name").alias("_d"), "r_regionkey")
    asked = table(spark, sf, "nation").select(F.col("n_name").alias("domain")).unionByName(region.select(F.col("_d").alias("domain")))
    return asked.join(F.broadcast(region), F.col("domain") == F.col("_d"), "left").select("domain", F.coalesce("r_regionkey", F.lit(-1)).alias("site_id"))


@Q("html_rows", "S4 P2", "SELECT page_id, CAST(length(html) AS BIGINT) AS size FROM pages WHERE html IS NOT NULL AND html <> '' ORDER BY page_id")
def html_rows(spark, sf):
    pages = table(spark, sf, "pages").filter(F.col("html").isNotNull() & (F.col("html") != ""))
    return pages.select("page_id", F.length("html").cast("long").alias("size")).orderBy("page_id")


@Q("ordered_kv_scan", "S15 K13", "SELECT l_partkey AS counter_id, CAST(0 AS BIGINT) AS value, CAST(sum(l_linenumber) AS BIGINT) AS increments FROM lineitem GROUP BY 1 ORDER BY 1")
def ordered_kv_scan(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("counter_id")).agg(F.sum("l_linenumber").alias("increments")).withColumn("value", F.lit(0).cast("long")).orderBy("counter_id")


@Q("entity_projection", "P1", PAGE + "SELECT id, site_id, page_type_code, url, strftime(accessed_time, '%Y-%m-%dT%H:%M:%S') AS accessed_time FROM page")
def entity_projection(spark, sf):
    return surrogate(spark, sf)["page"].select("id", "site_id", "page_type_code", "url", F.date_format("accessed_time", "yyyy-MM-dd'T'HH:mm:ss").alias("accessed_time"))


@Q("insert_new_rows", "K1", PAGE + "SELECT id, url FROM page WHERE id <= 100 UNION ALL SELECT id, url FROM page WHERE id > 100 AND id <= 200")
def insert_new_rows(spark, sf):
    page = surrogate(spark, sf)["page"].select("id", "url")
    return store.insert_new(page.filter("id <= 100"), page.filter("id > 50 AND id <= 200"), "id")


@Q("partial_update", "K2", PAGE + "SELECT id, CASE WHEN id % 3 = 0 THEN 'BINARY' ELSE page_type_code END AS page_type_code, CASE WHEN id % 3 = 1 THEN NULL ELSE url END AS url FROM page")
def partial_update(spark, sf):
    page = surrogate(spark, sf)["page"].select("id", "page_type_code", "url")
    change = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("page_type_code"), F.lit("BINARY"))).otherwise(F.create_map(F.lit("url"), F.lit(None).cast("string")))
    return store.partial_update(page, page.filter("id % 3 <> 2").select("id", change.alias("set")), "id")


@Q("delete_by_key", "K3", PAGE + "SELECT id, url FROM page WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_by_key(spark, sf):
    gone = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return store.delete_by_key(surrogate(spark, sf)["page"].select("id", "url"), gone, "id")


@Q("get_or_create_ids", "K5 D4", """
WITH e AS (SELECT r_regionkey AS id, r_name AS name FROM region),
f AS (SELECT DISTINCT n_name AS name FROM nation WHERE n_name NOT IN (SELECT name FROM e))
SELECT id, name FROM e UNION ALL SELECT CAST((SELECT max(id) FROM e) + row_number() OVER (ORDER BY name) AS INTEGER), name FROM f
""")
def get_or_create_ids(spark, sf):
    existing = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return store.get_or_create(existing, table(spark, sf, "nation").select(F.col("n_name").alias("name")), "name", "id")


@Q("seed_codes", "K6", "SELECT code, kind FROM (VALUES " + ", ".join([f"('{c}', 'page')" for c in PAGE_TYPES] + [f"('{c}', 'data')" for c in DATA_TYPES]) + ") v(code, kind)")
def seed_codes(spark, sf):
    codes = [(c, "page") for c in PAGE_TYPES] + [(c, "data") for c in DATA_TYPES]
    frame = spark.createDataFrame(codes, "code string, kind string")
    return store.seed_codes(frame.filter("kind = 'page'"), frame, "code")


@Q("base64_roundtrip", "K7", "SELECT doc_id, base64(encode(text)) AS encoded, text AS decoded FROM documents")
def base64_roundtrip(spark, sf):
    out = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "utf-8")), "\r\n", "").alias("encoded"))
    return out.withColumn("decoded", F.decode(F.unbase64("encoded"), "utf-8"))


@Q("counter_sum", "K13 C6", "SELECT user_id, count(*) AS counter FROM events GROUP BY 1")
def counter_sum(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.lit(1).cast("long")).alias("counter"))


DUP_SQL = "WITH h AS (SELECT doc_id, md5(text) AS h FROM documents), d AS (SELECT doc_id, h, min(doc_id) OVER (PARTITION BY h) AS original FROM h) "


def hashed_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("h"))


@Q("content_duplicates", "D1 A19", DUP_SQL + "SELECT doc_id, CASE WHEN doc_id = original THEN 'HTML' ELSE 'DUPLICATE' END AS page_type_code, CASE WHEN doc_id = original THEN h END AS content_hash FROM d")
def content_duplicates(spark, sf):
    found = store.content_duplicates(hashed_documents(spark, sf), "doc_id", "h")
    return found.select("doc_id", F.when(F.col("is_duplicate"), "DUPLICATE").otherwise("HTML").alias("page_type_code"), F.when(~F.col("is_duplicate"), F.col("h")).alias("content_hash"))


@Q("duplicate_edges", "D1", DUP_SQL + "SELECT doc_id AS from_page, original AS to_page FROM d WHERE doc_id <> original")
def duplicate_edges(spark, sf):
    return store.content_duplicates(hashed_documents(spark, sf), "doc_id", "h").filter("is_duplicate").select(F.col("doc_id").alias("from_page"), F.col("original").alias("to_page"))


@Q("page_upsert", "D2", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def page_upsert(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return store.upsert_by(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), "user_id", "event_id")


@Q("frontier_upsert", "D3", PAGE + """, o AS (SELECT url, CAST(id % 7 AS DOUBLE) AS priority FROM page WHERE id % 2 = 0 UNION ALL SELECT 'https://example.net/' || CAST(n_nationkey AS VARCHAR), 1.0 FROM nation)
SELECT o.url, CASE WHEN p.url IS NULL THEN 'inserted' WHEN p.page_type_code = 'FRONTIER' THEN 'updated' ELSE 'refused' END AS outcome,
       CASE WHEN p.url IS NOT NULL AND p.page_type_code <> 'FRONTIER' THEN 0.5 ELSE o.priority END AS priority
FROM o LEFT JOIN page p ON p.url = o.url
""")
def frontier_upsert(spark, sf):
    page = surrogate(spark, sf)["page"].withColumn("priority", F.lit(0.5))
    more = table(spark, sf, "nation").select(F.concat(F.lit("https://example.net/"), F.col("n_nationkey").cast("string")).alias("url"), F.lit(1.0).alias("priority"))
    offers = page.filter("id % 2 = 0").select("url", (F.col("id") % 7).cast("double").alias("priority")).unionByName(more)
    return store.frontier_upsert(page, offers)


@Q("edge_set", "D5", "SELECT DISTINCT l_suppkey AS from_page, l_linenumber AS to_page FROM lineitem WHERE l_suppkey <> l_linenumber")
def edge_set(spark, sf):
    return store.edge_set(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("from_page"), F.col("l_linenumber").alias("to_page")), "from_page", "to_page")


ERRORS = ('duplicate key value violates unique constraint "unq_url_idx"', "no quotes", 'two "a" and "b"')


@Q("constraint_name", "D6", "SELECT i, CASE WHEN len(string_split(m, '\"')) = 3 THEN split_part(m, '\"', 2) END AS name FROM (VALUES " + ", ".join(f"({i}, '{e}')" for i, e in enumerate(ERRORS)) + ") v(i, m)")
def constraint_name(spark, sf):
    rows = spark.createDataFrame(list(enumerate(ERRORS)), "i int, m string")
    return rows.select("i", F.when(F.size(F.split("m", '"')) == 3, F.get(F.split("m", '"'), 1)).alias("name"))


@Q("foreign_key_violations", "K1", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def foreign_key_violations(spark, sf):
    return store.violations(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_partkey", table(spark, sf, "part").filter("p_size > 25"), "p_partkey")


@Q("exclude_ids", "P4", "SELECT doc_id FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark)")
def exclude_ids(spark, sf):
    hidden = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("_id"))
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.join(hidden, F.col("doc_id").cast("string") == F.col("_id"), "left_anti")


@Q("non_null_filters", "P9 P10", "SELECT event_id, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
def non_null_filters(spark, sf):
    return table(spark, sf, "events").filter("ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)").select("event_id", "value")


@Q("dedupe_lists", "A19", "SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def dedupe_lists(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.size(F.array_distinct(F.sort_array(F.collect_set("event_type")))).cast("long").alias("kinds"))


@Q("name_map_join", "J7", "SELECT event_id, coalesce(m.label, event_type) AS label FROM events LEFT JOIN (VALUES ('click', 'Click'), ('error', 'Error')) m(k, label) ON m.k = event_type")
def name_map_join(spark, sf):
    # the map of names is a fixed handful
    names = F.broadcast(spark.createDataFrame([("click", "Click"), ("error", "Error")], "_k string, label string"))
    return table(spark, sf, "events").join(names, F.col("event_type") == F.col("_k"), "left").select("event_id", F.coalesce("label", "event_type").alias("label"))


@Q("random_sample", "O4", "SELECT event_id, user_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '/42'), event_id LIMIT 100")
def random_sample(spark, sf):
    """A seeded sample without replacement, of exactly 100 rows or all."""
    order = F.md5(F.concat(F.col("event_id").cast("string"), F.lit("/42")))
    return table(spark, sf, "events").select("event_id", "user_id").orderBy(order, "event_id").limit(100)


@Q("zipped_lists", "J6", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, turn, role FROM conversations")
def zipped_lists(spark, sf):
    """Parallel lists by position; where rows have a key, as here before they were gathered, a join by it needs no lists."""
    own = F.array_sort(F.collect_list(F.struct("turn", "role")))
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(own, lambda x: x["turn"]).alias("turns"), F.transform(own, lambda x: x["role"]).alias("roles"))
    placed = lists.select("conv_id", F.posexplode(F.arrays_zip("turns", "roles")).alias("place", "z"))
    return placed.select("conv_id", F.col("place").cast("long").alias("place"), F.col("z.turns").alias("turn"), F.col("z.roles").alias("role"))


@Q("schema_reflection", "S5", "SELECT column_name AS name, CASE data_type WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS type FROM information_schema.columns WHERE table_name = 'documents'")
def schema_reflection(spark, sf):
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in table(spark, sf, "documents").schema], "name string, type string")


@Q("model_folders", "F28", "SELECT page_id, replace(url, '/', '_') AS folder FROM pages")
def model_folders(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.replace("url", F.lit("/"), F.lit("_")).alias("folder"))
