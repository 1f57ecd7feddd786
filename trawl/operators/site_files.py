"""Robots rules and sitemaps of sites, from a fetched-files source: a function or a table of (url, content)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.operators.crawl import DEFAULT_DELAY, rules

_SITEMAP = r"(?im)^\s*sitemap\s*:\s*(\S+)"


def site_rows(domains: DataFrame, fetched: DataFrame, agent: str) -> DataFrame:
    """(domain, robots_content, sitemap_content, delay) of each row of domains (domain, such as https://example.com).

    fetched (url, content) holds what was got from the sites; a url that is missing or null was not to be had. Only the first
    sitemap that the rules name counts. Without rules, or if that sitemap is not to be had, both contents are empty and the
    delay is the default one; rules without a sitemap leave it null. A delay for the agent goes before one for all.
    """
    robots = fetched.select(F.col("url").alias("_robots_url"), F.col("content").alias("_robots"))
    maps = fetched.select(F.col("url").alias("_map_url"), F.col("content").alias("_map"))
    ruled = domains.join(robots, F.concat("domain", F.lit("/robots.txt")) == F.col("_robots_url"), "left")
    named = F.nullif(F.regexp_extract("_robots", _SITEMAP, 1), F.lit(""))
    full = ruled.withColumn("_named", named).join(maps, F.col("_named") == F.col("_map_url"), "left")
    lost = F.col("_robots").isNull() | (F.col("_named").isNotNull() & F.col("_map").isNull())

    @F.pandas_udf("double")
    def delay(texts: pd.Series) -> pd.Series:
        def of(text: str) -> float:
            found = rules(text)
            own = found.crawl_delay(agent)
            own = found.crawl_delay("*") if own is None else own
            return DEFAULT_DELAY if own is None else float(own)

        return texts.map(lambda t: DEFAULT_DELAY if t is None else of(t))

    return full.select(
        "domain", F.when(lost, "").otherwise(F.col("_robots")).alias("robots_content"), F.when(lost, "").otherwise(F.col("_map")).alias("sitemap_content"),
        F.when(lost, DEFAULT_DELAY).otherwise(delay("_robots")).alias("delay"),
    )


def fetched_by(urls: DataFrame, get: Callable[[str], str | None]) -> DataFrame:
    """(url, content) of urls by a fetching function, null where it gives none or fails; each url is asked for once."""

    @F.pandas_udf("string")
    def content(u: pd.Series) -> pd.Series:
        def one(url: str) -> str | None:
            try:
                return get(url)
            except Exception:  # noqa: BLE001  whatever the network does, the url was not to be had
                return None

        return u.map(one)

    return urls.select("url").distinct().select("url", content("url").alias("content"))


def sitemap_urls(xml):
    """The locations that a sitemap lists, in order."""
    return F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))
