"""Crawl control and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions import html as H
from trawl.functions import urls as U
from trawl.operators import crawl as C
from trawl.operators import focus as FO
from trawl.operators import models as M
from trawl.operators import site_files as SF
from trawl.plans.crawl_stats import LINKS_SQL, PAGE_SQL
from trawl.plans.url_queries import CANON_SQL
from trawl.registry import REGISTRY
from trawl.schema import surrogate, table
from trawl.scratch import bounded_batches, fresh_path, hand_out, materialise
from trawl.streaming import frontier as S
from trawl.streaming import workers as WK

Q = REGISTRY.query

FRONTIER_SQL = "WITH f AS (SELECT user_id AS u, event_type || '/' || CAST(user_id AS VARCHAR) AS url, event_id AS version, round(value, 4) AS priority, event_id % 7 AS from_page, event_id AS frontier_page FROM events) "


def frontier(spark, sf):
    return table(spark, sf, "events").select(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("version"), F.round("value", 4).alias("priority"), (F.col("event_id") % 7).alias("from_page"), F.col("event_id").alias("frontier_page"))


@Q("frontier_next", "O6 O7 W7", FRONTIER_SQL + "SELECT url, version, priority FROM f WHERE version = (SELECT max(g.version) FROM f g WHERE g.url = f.url) ORDER BY priority, url, version LIMIT 25")
def frontier_next(spark, sf):
    return C.frontier_next(frontier(spark, sf), 25).select("url", "version", "priority")


@Q("crawl_delay_schedule", "C3", "SELECT event_id, CAST(2.0 * (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) AS DOUBLE) AS start FROM events")
def crawl_delay_schedule(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type").withColumn("delay", F.lit(2.0))
    return C.delay_schedule(rows, "event_type", "event_id", "delay", F.floor(F.col("event_id") / 4096)).select("event_id", "start")


#: A site's delay in microseconds, by its name; the sites are the event types, whose events come in real time.
DELAY_SQL = "(100000000 * length(event_type))"
SLOTS_SQL = f"""
r AS (SELECT event_id, event_type AS site, event_type || '/' || CAST(user_id AS VARCHAR) AS url, epoch_us(ts) AS arrival, {DELAY_SQL} AS delay, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT event_id, site, i, arrival, arrival AS start, arrival + delay AS free FROM r WHERE i = 1
      UNION ALL SELECT r.event_id, r.site, r.i, r.arrival, greatest(r.arrival, s.free), greatest(r.arrival, s.free) + r.delay FROM s JOIN r ON r.site = s.site AND r.i = s.i + 1)
"""


def requests(spark, sf):
    """(event_id, site, url, arrival, delay) of each event, times in microseconds."""
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("site"), F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("url"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"), (F.length("event_type") * 100_000_000).cast("long").alias("delay"))


@Q("crawl_slots", "C3", f"WITH RECURSIVE {SLOTS_SQL} SELECT event_id, site, start AS start_us, start - arrival AS wait_us FROM s")
def crawl_slots(spark, sf):
    """The slot that each request reserves: not before it comes, and a delay after the one before it on its site."""
    day = F.floor(F.col("arrival") / 86_400_000_000)
    rows = C.slot_schedule(requests(spark, sf), "site", "arrival", "event_id", "delay", day)
    return rows.select("event_id", "site", F.col("start").alias("start_us"), (F.col("start") - F.col("arrival")).alias("wait_us"))


#: Microseconds without an entry after which a site's worker ends: the reference waits three seconds, the events come slower.
IDLE = 2 * 3_600_000_000


@Q("worker_stream", "C1 C3 W7", f"""
WITH RECURSIVE {SLOTS_SQL},
v AS (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY arrival, event_id) - 1 AS version, arrival - lag(arrival) OVER (PARTITION BY site ORDER BY i) > {IDLE} AS fresh,
        lead(arrival) OVER (PARTITION BY site ORDER BY i) AS later FROM r),
n AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY site ORDER BY i) AS worker FROM v)
SELECT 'entry' AS kind, n.site, n.event_id, url, version, worker, s.start AS at_us FROM n JOIN s ON s.event_id = n.event_id
UNION ALL
SELECT 'ended', site, NULL, NULL, NULL, worker, arrival + {IDLE} FROM n WHERE coalesce(later - arrival > {IDLE}, (arrival + {IDLE}) // 1000 + 1 <= (SELECT max(epoch_ms(ts)) FROM events))
""")
def worker_stream(spark, sf):
    """Entries of each site in the order that they come, in four micro-batches or more, with their versions, slots and workers."""
    root = hand_out(spark, fresh_path(spark, "workers"))
    WK.write_in_order(requests(spark, sf), f"{root}/source", "arrival", 4)
    return WK.run(spark, f"{root}/source", f"{root}/table", f"{root}/checkpoint", IDLE)


#: The budget of pages and the workers of the reference's settings.
BUDGET, WORKERS = 150, 4


@Q("crawl_budget", "C2", f"""
WITH RECURSIVE p AS (SELECT event_id, user_id % {WORKERS} AS worker, row_number() OVER (ORDER BY ts, event_id) AS number FROM events),
w AS (SELECT event_id, worker, number, CAST(0 AS BIGINT) AS counted, CAST([] AS BIGINT[]) AS ended, false AS done FROM p WHERE false
      UNION ALL SELECT NULL, NULL, 0, 0, [], false WHERE (SELECT count(*) FROM p) > 0
      UNION ALL SELECT p.event_id, p.worker, p.number, CASE WHEN w.counted >= {BUDGET} THEN w.counted ELSE w.counted + 1 END,
             CASE WHEN w.counted >= {BUDGET} AND NOT list_contains(w.ended, p.worker) THEN list_append(w.ended, p.worker) ELSE w.ended END, NOT list_contains(w.ended, p.worker)
      FROM w JOIN p ON p.number = w.number + 1 WHERE len(w.ended) < {WORKERS})
SELECT event_id, worker, number FROM w WHERE done
""")
def crawl_budget(spark, sf):
    """Pages by the time that they are done, dealt to workers by user: those that a crawl with a budget completes."""
    pages = table(spark, sf, "events").select("event_id", (F.col("user_id") % WORKERS).alias("worker"), "ts")
    done = C.within_budget(pages, ["ts", "event_id"], BUDGET, F.to_date("ts"))
    return done.select("event_id", "worker", "number")


QUESTION = "the para nicht and for une the"
MODEL = M.HashedEmbedder(64)
#: The embedder in SQL: signed counts of words by the first eight hex digits of their digest.
PRIORITY_SQL = LINKS_SQL + r"""
, k AS (SELECT page_id, """ + CANON_SQL.replace("url", "target") + r""" AS url FROM links),
m AS (SELECT url, count(DISTINCT page_id) AS seen, replace(split_part(regexp_extract(any_value(url), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', 2), '-', ' ') AS section FROM k GROUP BY url),
w AS (SELECT url, unnest(regexp_extract_all(lower(CASE WHEN trim(section) = '' THEN '' ELSE 'Ključne besede: ' || trim(section) || '.' END), '[\p{L}\p{N}_]{2,}')) AS word FROM m
      UNION ALL SELECT NULL, unnest(regexp_extract_all(lower('""" + QUESTION + r"""'), '[\p{L}\p{N}_]{2,}'))),
hashed AS (SELECT url, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM w),
v AS (SELECT url, (h // 2) % 64 AS i, sum(1 - 2 * (h % 2)) AS x FROM hashed GROUP BY url, i),
n AS (SELECT url, sqrt(sum(x * x)) AS norm FROM v GROUP BY url),
d AS (SELECT a.url, sum(a.x * b.x) AS dot FROM v a JOIN v b ON a.i = b.i AND b.url IS NULL WHERE a.url IS NOT NULL GROUP BY a.url)
SELECT m.url, seen - 1 AS version, round(-coalesce(dot / nullif(norm * (SELECT norm FROM n WHERE url IS NULL), 0), 0), 6) + 0.0 AS priority
FROM m LEFT JOIN n ON n.url = m.url LEFT JOIN d ON d.url = m.url
"""


def anchors(spark, sf):
    """(page_id, url, section, topic, link_title, summary, label, keywords) of each link of each page, canonical."""
    bounded_batches(spark)
    found = table(spark, sf, "pages").select("page_id", F.explode(H.anchors_column(F.col("html"), F.col("url"))).alias("a"))
    url = F.col("a.url")
    return found.select("page_id", url.alias("url"), U.section(url).alias("section"), U.topic(url).alias("topic"), U.link_title(url).alias("link_title"), "a.summary", "a.label", "a.keywords")


def scored(known):
    return known.select("url", (F.col("seen") - 1).alias("version"), (F.round("priority", 6) + 0.0).alias("priority"))


@Q("link_priority", "V7", PRIORITY_SQL)
def link_priority(spark, sf):
    return scored(C.prioritised(C.gathered(anchors(spark, sf)), QUESTION, MODEL))


@Q("frontier_rescore", "C5 V7 W7", PRIORITY_SQL)
def frontier_rescore(spark, sf):
    """The pages come in three batches; after each, the links that it had are scored again with all that is known of them."""
    pages = anchors(spark, sf)
    batches = [C.gathered(pages.filter(F.pmod("page_id", F.lit(3)) == k)) for k in range(3)]
    known = materialise(C.prioritised(batches[0], QUESTION, MODEL), "frontier")
    for found in batches[1:]:
        known = materialise(C.rescored(known, materialise(found, "found"), QUESTION, MODEL), "frontier")
    return scored(known)


ROBOTS = "User-agent: *\nDisallow: /en\nCrawl-delay: 3\n\nUser-agent: trawl\nDisallow: /fr\n"


@Q("robots_filter", "C4", "SELECT page_id, page_id % 5 <> 0 AND NOT starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1), '/en') AS allowed, CASE WHEN page_id % 5 = 0 THEN 1.0 ELSE 3.0 END AS crawl_delay FROM pages")
def robots_filter(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url").withColumn("robots", F.when(F.col("page_id") % 5 != 0, F.lit(ROBOTS)))
    return C.robots_allowed(rows, "url", "robots", "other").select("page_id", "allowed", "crawl_delay")


ROUNDS, BATCH, KEYWORD = 4, 40, "7"


def _crawl_sql() -> str:
    """The rounds one after another: what a round pops, and the frontier that it leaves."""
    parts = [f"page AS ({PAGE_SQL})", "edges AS MATERIALIZED (SELECT DISTINCT a.url AS source, b.url AS target FROM lineitem JOIN page a ON a.id = l_orderkey JOIN page b ON b.id = l_partkey)", "f0 AS (SELECT min(url) AS url FROM page)"]
    for n in range(ROUNDS):
        seen = " UNION ALL ".join(f"SELECT url FROM p{k}" for k in range(n)) or "SELECT NULL WHERE false"
        parts.append(f"p{n} AS MATERIALIZED (SELECT url FROM f{n} WHERE url NOT IN ({seen}) ORDER BY CASE WHEN contains(url, '{KEYWORD}') THEN 0 ELSE 1 END, url LIMIT {BATCH})")
        parts.append(f"f{n + 1} AS MATERIALIZED (SELECT url FROM f{n} UNION SELECT target FROM edges WHERE source IN (SELECT url FROM p{n}))")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS round, url FROM p{n}" for n in range(ROUNDS))


@Q("crawl_rounds", "C1 C2 C7", _crawl_sql())
def crawl_rounds(spark, sf):
    """A crawl of the store's pages along its links, from the first url, best first, with a budget of pages a round."""
    store = surrogate(spark, sf)
    pages = store["page"].select("id", "url")
    ends = lambda name, key: pages.select(F.col("id").alias(key), F.col("url").alias(name))
    links = store["link"].join(ends("source", "from_page"), "from_page").join(ends("target", "to_page"), "to_page").select("source", "target").distinct()
    seed = pages.agg(F.min("url")).first()[0] or ""
    return C.crawl_rounds(pages, materialise(links, "links"), seed, ROUNDS, BATCH, KEYWORD)


@Q("event_stream_counts", "C5", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def event_stream_counts(spark, sf):
    """The stream of the events; the counts of changed windows are written batch by batch, and a window that the watermark has
    passed leaves the state. Within a micro-batch, as which the file is read, nothing is late."""
    source = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    root = hand_out(spark, fresh_path(spark, "counts"))
    S.run_counts(S.event_counts(source), f"{root}/checkpoint", f"{root}/table")
    return S.latest_counts(spark, f"{root}/table").withColumn("start", F.col("start").cast("timestamp_ntz"))


@Q("crawl_rounds_stream", "C1 C5 D3", "SELECT event_type || '/' || CAST(user_id AS VARCHAR) AS url, round(min(value), 4) AS priority, count(*) AS seen FROM events GROUP BY 1")
def crawl_rounds_stream(spark, sf):
    source = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    offers = source.select(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("url"), F.round("value", 4).alias("priority"))
    root = hand_out(spark, fresh_path(spark, "frontier"))
    S.run_upserts(offers, f"{root}/checkpoint", f"{root}/table")
    return S.state(spark, f"{root}/table")


@Q("focused_relevance", "V18", r"""
WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2),
v AS (SELECT term FROM c GROUP BY term ORDER BY sum(n) DESC, term LIMIT 2000), k AS (SELECT c.* FROM c JOIN v ON v.term = c.term), t AS (SELECT lang, sum(n) + (SELECT count(*) FROM v) AS total FROM k GROUP BY 1),
p AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM documents)) AS prior FROM documents GROUP BY 1),
q AS (SELECT item_id, b.term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark) b JOIN v ON v.term = b.term GROUP BY 1, 2),
s AS (SELECT i.item_id, p.lang, p.prior + coalesce(sum(q.tf * ln((coalesce(k.n, 0) + 1.0) / t.total)), 0) AS l FROM benchmark i CROSS JOIN p JOIN t ON t.lang = p.lang LEFT JOIN q ON q.item_id = i.item_id LEFT JOIN k ON k.lang = p.lang AND k.term = q.term GROUP BY i.item_id, p.lang, p.prior),
e AS (SELECT item_id, lang, l, exp(l - max(l) OVER (PARTITION BY item_id)) AS e FROM s)
SELECT item_id, round(sum(CASE WHEN lang IN ('de', 'es') THEN e ELSE 0 END) / sum(e), 6) AS relevance, arg_max(lang, l) IN ('de', 'es') AS in_focus FROM e GROUP BY item_id
""")
def focused_relevance(spark, sf):
    """Items of benchmark by the classes of documents, the languages; German and Spanish are in focus."""
    model = FO.train(table(spark, sf, "documents"), "lang", "text", 2000)
    found = FO.relevance(table(spark, sf, "benchmark"), "item_id", "text", model, ("de", "es"))
    return found.select("item_id", F.round("relevance", 6).alias("relevance"), "in_focus")


@Q("site_files", "S11 C4", r"""
WITH d AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS domain FROM pages), n AS (SELECT domain, length(domain) % 4 AS n FROM d)
SELECT domain, CASE n WHEN 1 THEN 'User-agent: *' || chr(10) || 'Crawl-delay: 2' WHEN 2 THEN 'User-agent: *' || chr(10) || 'Crawl-delay: 7' || chr(10) || 'Sitemap: ' || domain || '/map.xml' ELSE '' END AS robots_content,
       CASE n WHEN 1 THEN NULL WHEN 2 THEN '<loc>' || domain || '/a</loc>' ELSE '' END AS sitemap_content, CASE n WHEN 1 THEN 2.0 WHEN 2 THEN 7.0 ELSE 1.0 END AS delay
FROM n
""")
def site_files(spark, sf):
    """Rules and first sitemaps of the sites of all pages: by the length of its name a site has none, rules alone, both, or
    rules with a sitemap that is not to be had."""
    domains = table(spark, sf, "pages").select(F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1).alias("domain")).distinct()
    kind = F.length("domain") % 4
    ruled = F.when(kind == 1, F.lit("User-agent: *\nCrawl-delay: 2")).when(kind >= 2, F.concat(F.lit("User-agent: *\nCrawl-delay: 7\nSitemap: "), "domain", F.lit("/map.xml")))
    mapped = F.when(kind == 2, F.concat(F.lit("<loc>"), "domain", F.lit("/a</loc>")))
    fetched = domains.select(F.concat("domain", F.lit("/robots.txt")).alias("url"), ruled.alias("content")).unionByName(domains.select(F.concat("domain", F.lit("/map.xml")).alias("url"), mapped.alias("content")))
    return SF.site_rows(domains, fetched, "trawl")
