"""URL canonicalisation, link tables, filters and frontier joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.functions import html as H
from trawl.functions import text as X
from trawl.functions import urls as U
from trawl.plans.crawl_stats import LINKS_SQL
from trawl.operators.ranking import numbered
from trawl.registry import REGISTRY
from trawl.schema import table
from trawl.scratch import bounded_batches

Q = REGISTRY.query

DOMAIN_SQL = r"regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '([^.]+\.[^.]+)$', 1)"
PATH_SQL = r"coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/')"
CANON_SQL = f"'https://' || {DOMAIN_SQL} || {PATH_SQL}"


@Q("canonical_urls", "F2", f"SELECT page_id, {CANON_SQL} AS canonical_url FROM pages")
def canonical_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical_url"))


@Q("site_domains", "F1", f"SELECT 'https://' || {DOMAIN_SQL} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def site_domains(spark, sf):
    return table(spark, sf, "pages").groupBy(U.site_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@Q("canonical_dedup", "D2 F1 F2", f"SELECT min(page_id) AS page_id, {CANON_SQL} AS canonical_url, count(*) AS versions, CAST(max(length(html)) AS BIGINT) AS longest_html FROM pages GROUP BY 2")
def canonical_dedup(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical_url"), F.length("html").alias("n"))
    return pages.groupBy("canonical_url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("versions"), F.max("n").cast("long").alias("longest_html")).select("page_id", "canonical_url", "versions", "longest_html")


@Q("stripped_urls", "F3", "SELECT page_id, regexp_extract(url, '^([^?#;]*)', 1) AS stripped_url FROM pages")
def stripped_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.without_query(F.col("url")).alias("stripped_url"))


@Q("url_sections", "F5", r"""
SELECT page_id, nullif(split_part(p, '/', 2), '') AS section, nullif(split_part(p, '/', 3), '') AS topic, len(string_split(p, '/')) AS part_count
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)
""")
def url_sections(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.nullif(U.section(url), F.lit("")).alias("section"), F.nullif(U.topic(url), F.lit("")).alias("topic"), F.size(U.parts(url)).cast("long").alias("part_count"))


def links(spark, sf):
    """(page_id, url, href, target) of each anchor."""
    pages = table(spark, sf, "pages")
    exploded = pages.select("page_id", "url", F.explode(U.hrefs(F.col("html"))).alias("href"))
    return exploded.withColumn("target", U.resolve_rooted(F.col("href"), F.col("url")))


@Q("page_links", "F4 F8 F9", LINKS_SQL + " SELECT page_id, href, target FROM links")
def page_links(spark, sf):
    return links(spark, sf).select("page_id", "href", "target")


@Q("link_metadata", "F6 F8", LINKS_SQL + r"""
, k AS (SELECT page_id, target, regexp_extract(target, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, url FROM links)
SELECT page_id, target, replace(split_part(p, '/', 2), '-', ' ') AS section, CASE WHEN len(string_split(p, '/')) > 2 THEN replace(split_part(p, '/', 3), '-', ' ') END AS topic,
       CASE WHEN contains(target, '.html') THEN left(replace(split_part(p, '/', -1), '-', ' '), greatest(length(split_part(p, '/', -1)) - 5, 0)) ELSE '' END AS link_title,
       CASE WHEN contains(url, '.html') THEN split_part(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', -1) END AS source_title
FROM k
""")
def link_metadata(spark, sf):
    target, url = F.col("target"), F.col("url")
    spaced = lambda c: F.replace(c, F.lit("-"), F.lit(" "))
    return links(spark, sf).select(
        "page_id", "target", spaced(U.section(target)).alias("section"), spaced(U.topic(target)).alias("topic"), U.link_title(target).alias("link_title"),
        F.when(F.contains(url, F.lit(".html")), F.element_at(U.parts(url), -1)).alias("source_title"),
    )


#: Links in boxes, which the pages of the test tables lack, put in at the start of each body with the page's number.
BOXES = (
    """<body><a onclick="window.open('https://example.com/a/x-""", """.html')"><span class="summary">late</span></a><div id="article-keywords"><a href="https://example.com/kljucna-beseda/w-""", """">word """,
    """ </a></div><div class="menu__items"><ul><li><a href="https://example.com/a/x-""", """.html"><span class="summary">first """, """</span><span class="label">label """,
    """</span></a></li></ul></div><div id="footer-bottom"><p><a href="https://example.com/a/x-""", """.html">again</a></p></div><div class="submenu"><p><b><a href="https://example.com/spored/s-""",
    """">s</a></b></p></div><div id="related-articles"><a href="https://example.com/a/r-""", """.html">r</a><a href="https://example.com/a/b-""", """.html">b</a></div><a class="read-more" href="https://example.com/a/b-""",
    """.html">more</a><div id="proad"><a href="/vsebine/oglasevanje">ads</a><a href="https://example.com/spored/p-""", """">p</a></div>""",
)
#: What the rules make of these boxes (two patterns find the address in the code): (page_id, url, place, summary, label, keywords, containers) of each link.
MARKED_SQL = LINKS_SQL + f"""
, k AS (SELECT page_id, {CANON_SQL.replace("url", "target")} AS url FROM links),
m AS (SELECT page_id, CAST(page_id AS VARCHAR) AS n, {CANON_SQL.replace("url", "(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/vsebine/oglasevanje')")} AS advert FROM pages WHERE contains(html, '<body>')),
boxes AS (SELECT page_id, v.* FROM m, LATERAL (VALUES
  ('https://example.com/kljucna-beseda/w-' || n, 1, NULL, NULL, ['kljucna-beseda']), ('https://example.com/a/x-' || n || '.html', 2, 'first ' || n, 'label ' || n, ['menu']),
  ('https://example.com/a/x-' || n || '.html', 3, NULL, NULL, ['footer']), ('https://example.com/spored/s-' || n, 4, NULL, NULL, ['spored', 'submenu']),
  ('https://example.com/a/r-' || n || '.html', 5, NULL, NULL, ['related-articles']), ('https://example.com/a/b-' || n || '.html', 6, NULL, NULL, ['read-more']),
  ('https://example.com/a/b-' || n || '.html', 7, NULL, NULL, CAST([] AS VARCHAR[])), (advert, 8, NULL, NULL, CAST([] AS VARCHAR[])),
  ('https://example.com/spored/p-' || n, 9, NULL, NULL, ['proad']), ('https://example.com/a/x-' || n || '.html', 10, 'late', NULL, CAST([] AS VARCHAR[])),
  ('https://example.com/a/x-' || n || '.html', 11, 'late', NULL, CAST([] AS VARCHAR[]))) v(url, place, summary, label, containers)),
every AS (SELECT page_id, url, 9 AS place, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS label, CAST([] AS VARCHAR[]) AS containers FROM k UNION ALL SELECT page_id, url, place, summary, label, containers FROM boxes),
marked AS (SELECT every.*, CASE WHEN m.n IS NULL THEN CAST([] AS VARCHAR[]) ELSE ['word ' || m.n] END AS keywords FROM every LEFT JOIN m ON m.page_id = every.page_id),
merged AS (SELECT page_id, url, count(*) AS seen, arg_min(coalesce(summary, ''), place) AS summary, arg_min(coalesce(label, ''), place) AS label, any_value(keywords) AS keywords, flatten(list(containers ORDER BY place)) AS containers FROM marked GROUP BY page_id, url)
"""


def marked_pages(spark, sf):
    """The pages with BOXES in their bodies."""
    number = F.col("page_id").cast("string")
    block = F.concat(*[x for part in BOXES for x in (F.lit(part), number)][:-1])
    bounded_batches(spark)
    return table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("<body>"), block))


@Q("link_metadata_merge", "D7", MARKED_SQL + "SELECT page_id, url, seen, summary, label, keywords, containers FROM merged")
def link_metadata_merge(spark, sf):
    """One row a link and page: metadata of its first link, containers of all but where a box replaces them."""
    merged = merged_links(spark, sf)
    return merged.select("page_id", "url", "seen", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("label", F.lit("")).alias("label"), "keywords", "containers")


def merged_links(spark, sf):
    found = marked_pages(spark, sf).select("page_id", F.posexplode(H.anchors_column(F.col("html"), F.col("url"))).alias("at", "a"))
    return merge_anchors(found)


def merge_anchors(found):
    """(page_id, url, seen, summary, label, keywords, containers) of anchors (page_id, at, a): on a repeated key within a page
    only the containers are added up, in the order of the anchors."""
    first = F.min_by(F.struct("a.summary", "a.label", "a.keywords"), F.col("at"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("at"), F.col("a.containers").alias("c"))))
    merged = found.groupBy("page_id", F.col("a.url").alias("url")).agg(F.count("*").alias("seen"), first.alias("f"), listed.alias("l"))
    return merged.select("page_id", "url", "seen", "f.*", F.flatten(F.transform("l", lambda x: x["c"])).alias("containers"))


ASKED = "The first word of a label and 7"


def _bow_sql(text: str) -> str:
    """The cosine of the word counts of a text and ASKED."""
    words = lambda x: f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    count = lambda of, w: f"CAST(len(list_filter({of}, lambda y: y = {w})) AS DOUBLE)"
    a, b = words(text), words(f"'{ASKED}'")
    square = lambda of: f"sqrt(coalesce(list_sum(list_transform({of}, lambda x: {count(of, 'x')})), 0))"
    return f"coalesce(list_sum(list_transform({a}, lambda x: {count(b, 'x')})) / nullif({square(a)} * {square(b)}, 0), 0)"


@Q("bow_link_priority", "V8", MARKED_SQL + r"""
, t AS (SELECT m.page_id, m.url, m.summary, m.label, m.keywords, regexp_extract(m.url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
          CASE WHEN contains(p.url, '.html') THEN split_part(regexp_extract(p.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', -1) ELSE '' END AS source FROM merged m JOIN pages p ON p.page_id = m.page_id),
x AS (SELECT page_id, url, summary, label, source, array_to_string(keywords, ' ') AS words, replace(split_part(path, '/', 2), '-', ' ') || ' ' || replace(split_part(path, '/', 3), '-', ' ') AS place,
        CASE WHEN contains(url, '.html') THEN left(replace(split_part(path, '/', -1), '-', ' '), greatest(length(split_part(path, '/', -1)) - 5, 0)) ELSE '' END AS title FROM t)
SELECT url, count(*) AS occurrences, round(avg(""" + " + ".join(_bow_sql(c) for c in ("source", "words", "title", "summary", "place", "label")) + """), 6) AS priority FROM x GROUP BY url
""")
def bow_link_priority(spark, sf):
    """The priority of each link by the words of its metadata, over all pages that have it."""
    own = merged_links(spark, sf).join(table(spark, sf, "pages").select("page_id", F.col("url").alias("base")), "page_id")
    spaced = lambda c: F.replace(c, F.lit("-"), F.lit(" "))
    url, base = F.col("url"), F.col("base")
    facts = own.select(
        "url", F.when(F.contains(base, F.lit(".html")), F.element_at(U.parts(base), -1)).alias("source_title"), F.array_join("keywords", " ").alias("keywords"), U.link_title(url).alias("link_title"), "summary",
        F.concat_ws(" ", spaced(U.section(url)), spaced(U.topic(url))).alias("place"), "label",
    )
    score = X.bow_priority(ASKED, [F.col(c) for c in ("source_title", "keywords", "link_title", "summary", "place", "label")])
    return facts.groupBy("url").agg(F.count("*").alias("occurrences"), F.round(F.avg(score), 6).alias("priority"))


@Q("link_filter", "P6", LINKS_SQL + r"""
SELECT page_id, target FROM links WHERE len(string_split(href, '/')) >= 2 AND split_part(href, '/', 2) <> 's' AND contains(target, 'example.com')
""")
def link_filter(spark, sf, site: str = "example.com"):
    p = U.parts(F.col("target"))
    return links(spark, sf).filter((F.size(p) >= 2) & (F.get(p, 1) != "s") & F.contains("target", F.lit(site))).select("page_id", "target")


#: In turn each link of the pages is taken as it is and in the other spellings that the rules tell apart.
SPELLINGS = ("{}", "#{}", "mailto:x@example.org{}", " javascript:{}", "tel:{}", "https://example.org{}", "//cdn.example.org{}", "relative{}", "{}?javascript:", "")
SPELLED_SQL = LINKS_SQL + ", t AS (SELECT DISTINCT page_id, href FROM links), s AS (SELECT page_id, href AS link, CASE (page_id + length(href)) % 10 " + " ".join(f"WHEN {k} THEN replace('{x}', '{{}}', href)" for k, x in enumerate(SPELLINGS)) + " END AS href FROM t)"


def in_turn(key, spellings, value):
    """value put into the spelling that the key picks."""
    return F.replace(F.element_at(F.array(*[F.lit(x) for x in spellings]), F.pmod(key, F.lit(len(spellings))).cast("int") + 1), F.lit("{}"), value)


def spelled_links(spark, sf):
    own = links(spark, sf).select("page_id", "href").distinct()
    return own.select("page_id", F.col("href").alias("link"), in_turn(F.col("page_id") + F.length("href"), SPELLINGS, F.col("href")).alias("href"))


@Q("href_filter", "P7", SPELLED_SQL + " SELECT page_id, link, href FROM s WHERE NOT regexp_matches(trim(href), '^(javascript:|mailto:|tel:|#)')")
def href_filter(spark, sf):
    return spelled_links(spark, sf).filter(U.wanted_href(F.col("href")))


@Q("simple_links", "F33", SPELLED_SQL + """
SELECT page_id, link, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://example.org' || href END AS target FROM s
""")
def simple_links(spark, sf):
    return spelled_links(spark, sf).select("page_id", "link", U.simple_link(F.col("href"), F.lit("https://example.org")).alias("target"))


CODES = ("location.href='{}.html'", "window.open( \"{}\" )", "{Url: '{}', PlaybackUrl: '{}.html'}", "go('x{}.html'); go(\"y.html\")", "", "nothing {}")
_SQL_PATTERNS = " || ".join("regexp_extract_all(c, '" + p.replace("'", "''") + "', 1)" for p in U.ONCLICK_PATTERNS)
CODES_SQL = LINKS_SQL + ", t AS (SELECT DISTINCT page_id, href FROM links), s AS (SELECT page_id, href, CASE (page_id + length(href)) % 6 " + " ".join("WHEN {} THEN replace('{}', '{}', href)".format(k, x.replace("'", "''"), "{}") for k, x in enumerate(CODES)) + " END AS c FROM t)"


@Q("onclick_candidates", "F7", CODES_SQL + f" SELECT page_id, href, {_SQL_PATTERNS} AS candidates FROM s")
def onclick_candidates(spark, sf):
    own = links(spark, sf).select("page_id", "href").distinct()
    code = in_turn(F.col("page_id") + F.length("href"), CODES, F.col("href"))
    return own.select("page_id", "href", U.onclick_candidates(code).alias("candidates"))


@Q("unvisited_links", "J4", LINKS_SQL + "SELECT DISTINCT target FROM links WHERE target NOT IN (SELECT target FROM links WHERE page_id % 2 = 0)")
def unvisited_links(spark, sf):
    all_links = links(spark, sf)
    visited = all_links.filter("page_id % 2 = 0").select("target")
    return all_links.select("target").distinct().join(visited, "target", "left_anti")


@Q("allowed_links", "J5", LINKS_SQL + r"SELECT page_id, target FROM links WHERE regexp_extract(regexp_extract(target, '^[a-z]+://([^/?#]*)', 1), '([^.]+\.[^.]+)$', 1) IN ('example.com', 'example.net')")
def allowed_links(spark, sf):
    # the list of allowed sites is a parameter of the crawl: a handful of names
    allowed = F.broadcast(spark.createDataFrame([("example.com",), ("example.net",)], "_site string"))
    found = links(spark, sf)
    return found.join(allowed, U.registered_domain(F.col("target")) == F.col("_site"), "left_semi").select("page_id", "target")


@Q("validity_filter", "P5", LINKS_SQL + r"""
SELECT DISTINCT target FROM links
WHERE regexp_extract(regexp_extract(target, '^[a-z]+://([^/?#]*)', 1), '([^.]+\.[^.]+)$', 1) = 'example.com'
  AND target NOT IN (SELECT target FROM links WHERE page_id % 2 = 0) AND NOT starts_with(href, '/the')
""")
def validity_filter(spark, sf):
    all_links = links(spark, sf)
    visited = all_links.filter("page_id % 2 = 0").select("target")
    mine = all_links.filter((U.registered_domain(F.col("target")) == "example.com") & ~F.startswith("href", F.lit("/the")))
    return mine.select("target").distinct().join(visited, "target", "left_anti")


@Q("frontier_versions", "W7", LINKS_SQL + "SELECT target, page_id, href, row_number() OVER (PARTITION BY target ORDER BY page_id) - 1 AS version, page_id = max(page_id) OVER (PARTITION BY target) AS current FROM (SELECT DISTINCT page_id, href, target FROM links)")
def frontier_versions(spark, sf):
    found = links(spark, sf).select("page_id", "href", "target").distinct()
    versioned = numbered(found, "target", "page_id", F.floor(F.col("page_id") / 4096), "version")
    return versioned.select("target", "page_id", "href", "version", (F.col("version") + 1 == F.col("group_size")).alias("current"))


@Q("unresolved_joins", "F4", LINKS_SQL + r"""
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*/[^/]*$', '') || substr(href, 2) AS target FROM links
""")
def unresolved_joins(spark, sf):
    """Resolution of relative references too, which needs the full RFC algorithm."""
    found = links(spark, sf).select("page_id", "url", "href")
    return found.select("page_id", U.resolve(F.concat(F.lit(".."), F.col("href")), F.col("url")).alias("target"))
