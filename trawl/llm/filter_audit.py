"""Operator 13, filter interaction audit: a cube over the failure flags of five filters and the part.

Each document is reduced to its part, five flags and two marks, and documents are counted by these (a few rows a task
before the exchange). A CUBE over part and flags then gives, for each part and each set of filters, the row in which
exactly these flags are grouped and all false: the documents that survive the set. A step of an order goes from the
survivors of one set to those of a larger one, so its figures are differences between two survivor rows, joined by part
and set; no document is looked at again for any of the 120 orders.

Defined cases: a null text counts as empty and equals other empty texts; a null lang is the part of the empty string and
shares it with a lang that is empty; a row with a null id is never a copy and no copy of it is one; rows that repeat the
smallest id of their text are no copies either, and count once each; of several labels of an id any that is 1 counts, and
labels without documents count nothing; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.shared import documents, salted_join
from trawl.scratch import Scratch, materialise

LETTERS = "ABCDE"
ALL = (1 << len(LETTERS)) - 1
SPACES = r"[\x20\x09-\x0D]+"


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def failure_flags(text: Column) -> dict[str, Column]:
    """The flags that depend on the text alone, which is not null: A to D."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of each document, all but part boolean."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        read = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.sha2(F.encode(text, "utf-8"), 256).alias("digest"),
            *[flag.alias(f) for f, flag in failure_flags(text).items()],
        )
        rows = scratch.write(read.withColumn("digest", F.unhex("digest")), "flags")
        groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        groups = scratch.write(groups.filter("n > 1"), "copied")
        # rows that are alone with their text need no partner, so only groups of copies meet
        told = salted_join(rows, groups.select("digest", "first_id"), "digest", "left", counts=groups.select("digest", "n"))
        told = told.withColumn("E", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
        marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
        known = told.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left")
        # null ids match no label and would meet in one task
        unknown = told.filter("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
        no = F.lit(False)
        out = known.unionByName(unknown).select("part", *LETTERS, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
        ones = lambda c: F.sum(F.col(c).cast("long"))
        return materialise(out.groupBy("part", *LETTERS).agg(F.count(F.lit(1)).alias("n"), ones("good").alias("good"), ones("toxic").alias("toxic")), "cells")


def survivors(cells: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of a part that pass every filter of mask, for each of the 32 masks."""
    #: grouping_id has one bit a cubed column, the first one highest, set where the column is rolled up.
    cube = cells.cube("part", *LETTERS).agg(F.grouping_id().alias("rolled"), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    passes = F.lit(True)
    mask = F.lit(0)
    for k, f in enumerate(LETTERS):
        grouped = F.col("rolled").bitwiseAND(F.lit(1 << (len(LETTERS) - 1 - k))) == 0
        passes = passes & (~grouped | ~F.col(f))
        mask = mask + F.when(grouped, bit(f)).otherwise(0)
    own = cube.filter(F.col("rolled").bitwiseAND(F.lit(1 << len(LETTERS))) == 0).filter(passes)
    found = own.select("part", mask.alias("mask"), "n", "good", "toxic")
    # subsets that nothing survives have no row in the cube
    wanted = cells.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("mask"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "good", "toxic")]
    return wanted.join(found, ["part", "mask"], "left").select("part", "mask", *zero)


def steps() -> list[tuple[str, int, str, int, int]]:
    """(filter_order, step, filter, mask before, mask after) of all orders: 600 rows whatever the input."""
    out = []
    for order in permutations(LETTERS):
        before = 0
        for k, f in enumerate(order, 1):
            out.append(("".join(order), k, f, before, before | bit(f)))
            before |= bit(f)
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report: a row a part, order and step."""
    spark = docs.sparkSession
    cells = flagged(docs, labels)
    found = materialise(survivors(cells), "survivors")
    plan = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, filter string, mask int, after int"))
    later = found.select("part", F.col("mask").alias("after"), *[F.col(c).alias(f"{c}_after") for c in ("n", "good", "toxic")])
    lost = lambda c: (F.col(c) - F.col(f"{c}_after"))
    taken = found.join(plan, "mask").join(later, ["part", "after"])
    taken = taken.select("part", "filter_order", "step", "filter", F.col("n_after").alias("kept"), lost("n").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    # a filter's failures are all less its survivors; those of no other filter are the survivors of the others less those of all
    roles = [(f, m, fails, unique) for f in LETTERS for m, fails, unique in ((0, 1, 0), (bit(f), -1, 0), (ALL ^ bit(f), 0, 1), (ALL, 0, -1))]
    role = F.broadcast(spark.createDataFrame(roles, "filter string, mask int, fails int, only int"))
    alone = found.join(role, "mask").groupBy("part", "filter").agg(F.sum(F.col("n") * F.col("fails")).alias("fails"), F.sum(F.col("n") * F.col("only")).alias("unique_fails"))
    shares = taken.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    out = taken.join(alone.join(shares, ["part", "filter"]), ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's report over all documents and labels."""
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words FROM t
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [
      len(words) < 100,
      100 * len(list_distinct(words)) < 80 * len(words),
      100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x),
      regexp_matches(x, '[#$%&*|]'),
      coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY x), false)] AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), e AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM d GROUP BY ALL
), f AS (
  SELECT unnest(range(1, 6)) AS k, unnest(['A', 'B', 'C', 'D', 'E']) AS letter
), o AS (
  SELECT a.k AS k1, b.k AS k2, c.k AS k3, d.k AS k4, e.k AS k5, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), s AS (
  SELECT filter_order, unnest(range(1, 6)) AS step, [k1, k2, k3, k4, k5] AS ks FROM o
), r AS (
  SELECT e.part, s.filter_order, s.step, ks[s.step] AS k, e.n, e.good, e.toxic,
         e.fails[ks[s.step]] AS failing,
         len(list_filter(ks[1:s.step - 1], lambda j: e.fails[j])) > 0 AS gone,
         len(list_filter(e.fails, lambda z: z)) = 1 AS single
  FROM e, s
), c AS (
  SELECT part, filter_order, step, k,
         sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failing AND single THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND failing THEN n * good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND failing THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM c
"""
