"""Relational store operators: lookups, upserts, deletes, key assignment, duplicate resolution.

All are set operations over DataFrames; none loops over rows. A unique constraint becomes a window or an anti-join on its
key, so each write is one shuffle on that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_key(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the given values; filters reach the scan."""
    for name, value in keys.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def first_by(df: DataFrame, condition: Column, order: str) -> DataFrame:
    """The first match by `order`."""
    return df.filter(condition).orderBy(order).limit(1)


def insert_new(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """existing plus the rows whose key is new; of new rows that share a key the first by all columns goes in."""
    fresh = rows.join(existing.select(key), key, "left_anti")
    nth = F.row_number().over(W.partitionBy(key).orderBy(*[c for c in rows.columns if c != key]))
    return existing.unionByName(fresh.withColumn("_n", nth).filter("_n = 1").drop("_n").select(*existing.columns))


def partial_update(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """changes has the key and `set`, a map of column to new text; only the columns named there change, also to null."""
    joined = existing.join(changes.select(key, "set"), key, "left")
    out = []
    for f in existing.schema.fields:
        if f.name == key:
            out.append(F.col(key))
        else:
            has = F.coalesce(F.map_contains_key("set", F.lit(f.name)), F.lit(False))
            out.append(F.when(has, F.try_element_at("set", F.lit(f.name)).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
    return joined.select(*out)


def delete_by_key(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti")


def get_or_create(existing: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """existing plus an id for each new name, numbered in the order of the names after the largest id.

    Names that are new are distinct first; numbering needs them in one order, so this is for dimension tables.
    """
    fresh = names.select(name).filter(F.col(name).isNotNull()).distinct().join(existing.select(name), name, "left_anti")
    last = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    numbered = fresh.withColumn("_n", F.row_number().over(W.orderBy(name))).join(F.broadcast(last), F.lit(True))
    return existing.select(key, name).unionByName(numbered.select((F.col("_last") + F.col("_n")).cast(existing.schema[key].dataType).alias(key), name))


def seed_codes(existing: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Insert codes, doing nothing on conflict."""
    return existing.unionByName(codes).dropDuplicates([key])


def upsert_by(existing: DataFrame, rows: DataFrame, key: str, arrival: str) -> DataFrame:
    """One row a key, the latest by `arrival`; both sides have the same columns."""
    return existing.unionByName(rows).groupBy(key).agg(F.max_by(F.struct(*existing.columns), arrival).alias("_r")).select("_r.*")


def content_duplicates(pages: DataFrame, key: str, content_hash: str) -> DataFrame:
    """pages with `original` (least id of the hash) and `is_duplicate`; a null hash has no duplicates.

    The original is found by a pre-aggregated group and joined back, so that a very common hash does not meet in one task.
    """
    firsts = pages.filter(F.col(content_hash).isNotNull()).groupBy(F.col(content_hash).alias("_h")).agg(F.min(key).alias("_first"))
    joined = pages.join(firsts, F.col(content_hash) == F.col("_h"), "left")
    return joined.withColumn("original", F.coalesce("_first", key)).withColumn("is_duplicate", F.col(key) != F.col("original")).drop("_h", "_first")


def frontier_upsert(pages: DataFrame, offers: DataFrame, url: str = "url") -> DataFrame:
    """offers (url, priority) against pages (url, page_type_code, priority): the outcome and priority of each offer.

    New urls are inserted, urls still in the frontier get the new priority, crawled urls refuse it.
    """
    known = pages.select(F.col(url).alias("_url"), F.col("page_type_code").alias("_type"), F.col("priority").alias("_old"))
    joined = offers.join(known, F.col(url) == F.col("_url"), "left")
    outcome = F.when(F.col("_url").isNull(), "inserted").when(F.col("_type") == "FRONTIER", "updated").otherwise("refused")
    return joined.select(url, outcome.alias("outcome"), F.when(outcome == "refused", F.col("_old")).otherwise(F.col("priority")).alias("priority"))


def edge_set(links: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct edges without self-links."""
    return links.filter(F.col(source) != F.col(target)).select(source, target).distinct()


def violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose foreign key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")
