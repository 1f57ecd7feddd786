"""Crawl control: frontier rounds, politeness schedule, robots rules, best-first crawling over a page source."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.functions import urls as U
from trawl.functions.text import metadata_sentence
from trawl.operators.models import Embedder, similarity_column
from trawl.scratch import Scratch, materialise

DEFAULT_DELAY = 1.0


def frontier_next(frontier: DataFrame, n: int = 1) -> DataFrame:
    """The n best entries by (priority, url, version, from_page, frontier_page), stale versions discarded.

    n = 1 is best-first order; larger n pops a batch whose order differs from one-by-one popping.
    """
    latest = frontier.groupBy(F.col("url").alias("_u")).agg(F.max("version").alias("_v"))
    live = frontier.join(latest, (F.col("url") == F.col("_u")) & (F.col("version") == F.col("_v")), "left_semi")
    return live.orderBy("priority", "url", "version", "from_page", "frontier_page").limit(n)


def delay_schedule(requests: DataFrame, domain: str, order: str, delay: str, bucket: Column | None = None) -> DataFrame:
    """requests with `start`: seconds from the first slot of its domain, each a delay after the one before.

    bucket, if given, does not fall as order rises: a domain is then summed bucket by bucket in as many tasks as it has
    buckets, and only the buckets' sums are run through in one.
    """
    if bucket is None:
        own = W.partitionBy(domain).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return requests.withColumn("start", F.coalesce(F.sum(delay).over(own), F.lit(0.0)))
    rows = requests.withColumn("_b", bucket)
    sums = rows.groupBy(F.col(domain).alias("_d"), F.col("_b").alias("_k")).agg(F.sum(delay).alias("_s"))
    before = W.partitionBy("_d").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_d", "_k", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_before"))
    inside = W.partitionBy(domain, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum(delay).over(inside), F.lit(0.0)))
    joined = placed.join(starts, F.col(domain).eqNullSafe(F.col("_d")) & F.col("_b").eqNullSafe(F.col("_k")))
    return joined.withColumn("start", F.col("_before") + F.col("_in")).select(*requests.columns, "start")


def slot_schedule(requests: DataFrame, domain: str, arrival: str, order: str, delay: str, bucket: Column) -> DataFrame:
    """requests with `start`, the slot of each: the later of its arrival and its domain's next free time, which then moves to
    start + delay. arrival and delay are whole numbers of one unit; requests are served in order of arrival, then `order`.

    With D the delays summed up before a request, start = D + max over all requests up to it of (arrival - D): a prefix scan
    in (max, +). bucket does not fall as arrival rises; a domain is scanned bucket by bucket in as many tasks as it has
    buckets, and only one row a bucket (its sum and its maximum) goes through the scan over buckets.
    """
    with Scratch(requests.sparkSession) as scratch:
        rows = requests.withColumn("_b", bucket)
        inside = W.partitionBy(domain, "_b").orderBy(arrival, order)
        before = F.coalesce(F.sum(delay).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
        ahead = rows.withColumn("_d", before).withColumn("_m", F.max(F.col(arrival) - F.col("_d")).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
        ahead = scratch.write(ahead, "slots")
        sums = ahead.groupBy(F.col(domain).alias("_k"), F.col("_b").alias("_n")).agg(F.sum(delay).alias("_s"), F.max("_m").alias("_top"))
        over = W.partitionBy("_k").orderBy("_n").rowsBetween(W.unboundedPreceding, -1)
        placed = sums.withColumn("_before", F.coalesce(F.sum("_s").over(over), F.lit(0)).cast("long"))
        placed = placed.select("_k", "_n", "_before", F.max(F.col("_top") - F.col("_before")).over(over).alias("_most"))
        joined = ahead.join(placed, F.col(domain).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_n")))
        start = F.col("_before") + F.col("_d") + F.greatest(F.col("_most"), F.col("_m") - F.col("_before"))
        return materialise(joined.withColumn("start", start).select(*requests.columns, "start"), "slots")


def within_budget(pages: DataFrame, order: list[str], budget: int, bucket: Column) -> DataFrame:
    """pages with `number` (from 1, in order of completion), those that a crawl with this budget completes: a worker looks at
    the count only after a page, so each of them may complete one more, as many above the budget as there are workers at most.

    Pages have a `worker` from 0. The count rises with each page until it is the budget; from then on a worker's next page is
    its last, and is not counted. bucket does not fall in this order, so that numbering is spread over tasks.
    """
    with Scratch(pages.sparkSession) as scratch:
        inside = W.partitionBy("_b").orderBy(*order)
        rows = scratch.write(pages.withColumn("_b", bucket).withColumn("_i", F.row_number().over(inside)), "pages")
        sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
        starts = sizes.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_start"))
        numbered = rows.join(starts, "_b").withColumn("number", F.col("_start") + F.col("_i"))
        over = numbered.filter(F.col("number") > budget)
        # workers are a set number, so this has as many rows
        last = over.groupBy("worker").agg(F.min("number").alias("_last"))
        done = numbered.join(F.broadcast(last), "worker", "left").filter((F.col("number") <= budget) | (F.col("number") == F.col("_last")))
        return materialise(done.select(*pages.columns, "number"), "crawled")


def rules(text: str) -> RobotFileParser:
    out = RobotFileParser()
    out.parse(text.splitlines())
    return out


def robots_allowed(rows: DataFrame, url: str, robots: str, agent: str) -> DataFrame:
    """rows with `allowed` and `crawl_delay`; no rules allow everything, null rules nothing."""

    @F.pandas_udf("allowed: boolean, crawl_delay: double")
    def judge(u: pd.Series, r: pd.Series) -> pd.DataFrame:
        known: dict[str, RobotFileParser] = {}
        out = []
        for link, text in zip(u, r, strict=True):
            if text is None:
                out.append((False, DEFAULT_DELAY))
                continue
            if text not in known:
                known[text] = rules(text)
            wait = known[text].crawl_delay(agent)
            out.append((known[text].can_fetch(agent, link), float(wait) if wait is not None else DEFAULT_DELAY))
        return pd.DataFrame(out, columns=["allowed", "crawl_delay"])

    return rows.withColumn("_j", judge(url, robots)).select(*rows.columns, "_j.allowed", "_j.crawl_delay")


def crawl_rounds(pages: DataFrame, links: DataFrame, seed: str, rounds: int, batch: int, keyword: str = "") -> DataFrame:
    """(round, url): a crawl over a page source (pages: url; links: source, target) from a seed, `batch` pages a round, best first.

    Priority is 0 where the url has the keyword, else 1. The links are scanned by join each round; frontier and visited urls
    are tables in the shared folder that a round writes anew, so a round can be repeated after a loss. A round pops `batch`
    urls, a set size, which are all that the driver and the broadcast hold.
    """
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        visited = scratch.write(spark.createDataFrame([], "round int, url string"), "visited")
        frontier = scratch.write(spark.createDataFrame([(seed,)], "url string"), "frontier")
        for n in range(rounds):
            live = frontier.join(visited.select("url"), "url", "left_anti").join(pages.select("url"), "url", "left_semi")
            order = F.when(F.contains("url", F.lit(keyword)), 0).otherwise(1)
            urls = [r["url"] for r in live.select("url", order.alias("p")).orderBy("p", "url").limit(batch).collect()]
            if not urls:
                break
            now = spark.createDataFrame([(n, u) for u in urls], "round int, url string")
            found = links.join(F.broadcast(now.select(F.col("url").alias("source"))), "source", "left_semi").select(F.col("target").alias("url"))
            frontier = scratch.replace(frontier, frontier.unionByName(found).distinct(), "frontier")
            visited = scratch.replace(visited, visited.unionByName(now), "visited")
        return materialise(visited, "crawled")


def page_source(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, links) of a table (url, html), canonical: distinct urls, and distinct pairs of source and target."""
    url = U.canonical(F.col("url"))
    found = pages.select(url.alias("source"), "url", F.explode(U.hrefs(F.col("html"))).alias("href"))
    links = found.select("source", U.canonical(U.resolve_rooted(F.col("href"), F.col("url"))).alias("target"))
    return pages.select(url.alias("url")).distinct(), links.filter("target IS NOT NULL").distinct()


def gathered(anchors: DataFrame) -> DataFrame:
    """(url, seen, titles, summaries, keywords, labels): what is known of each link of anchors (page_id, url, section, topic,
    link_title, summary, label, keywords); seen is the number of pages that it is on."""
    spaced = lambda c: F.trim(F.replace(F.col(c), F.lit("-"), F.lit(" ")))
    own = anchors.select("page_id", "url", F.array("link_title").alias("t"), F.array("summary").alias("s"), F.concat(F.array(spaced("topic"), spaced("section")), F.coalesce("keywords", F.array().cast("array<string>"))).alias("k"), F.array("label").alias("l"))
    return own.groupBy("url").agg(
        F.count_distinct("page_id").alias("seen"),
        *[F.array_distinct(F.flatten(F.collect_set(c))).alias(n) for c, n in (("t", "titles"), ("s", "summaries"), ("k", "keywords"), ("l", "labels"))],
    )


def prioritised(known: DataFrame, query: str, model: Embedder) -> DataFrame:
    """known (as of gathered) with `priority`: minus the cosine of the query's vector and that of the link's metadata."""
    text = metadata_sentence(F.col("titles"), F.col("summaries"), F.col("keywords"), F.col("labels"))
    return known.withColumn("priority", -similarity_column(text, query, model))


def rescored(known: DataFrame, found: DataFrame, query: str, model: Embedder) -> DataFrame:
    """known with what a later batch of pages has found of its links: metadata is added up, the links that were found are
    scored again with all of it, and each page that has a link raises its count; the others stay as they are."""
    lists = ("titles", "summaries", "keywords", "labels")
    old = known.select(F.col("url").alias("_u"), F.col("seen").alias("_seen"), *[F.col(c).alias(f"_{c}") for c in lists])
    none = F.array().cast("array<string>")
    both = found.join(old, F.col("url") == F.col("_u"), "left").select(
        "url", (F.col("seen") + F.coalesce("_seen", F.lit(0))).alias("seen"), *[F.array_distinct(F.concat(F.coalesce(f"_{c}", none), F.col(c))).alias(c) for c in lists]
    )
    untouched = known.join(found.select("url"), "url", "left_anti")
    return untouched.unionByName(prioritised(both, query, model))
