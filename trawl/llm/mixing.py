"""Operator 10, mixing sources to target weights by iterative proportional fitting.

Tokens (white-space separated words) are summed by cell (source, language, topic). Raking scales the cells in turn until
the totals of each source, language and topic meet their targets, with no cell above the tokens it has; a cell's share is
then the probability with which its documents are kept, decided by a hash of the id, so a rerun decides alike.

Targets are shares by margin; without given ones a margin's shares are its token totals to the power TEMPERATURE, which
lifts small sources and holds down a dominant one. KEEP is the share of all tokens to aim at. Cells are pre-aggregated; up
to MAX_CELLS of them (some megabytes, counted first) are raked on the driver and broadcast, more are raked as a table.

The topic is any string column over the text that the caller names; topic_of, the default, tells surfaces apart, since the
documents carry no topic.

Defined cases: null source, language or topic is a category of its own; a null or empty text has no tokens and the
probability of its cell; a cell without tokens gets probability 1; a null id hashes as a constant; repeated ids share
their fate within a cell; a target for an absent category is ignored; where bounds make the targets unreachable the
fit is the last iterate, which still obeys the bounds; `mix` returns each row of the input as one column `document`, so no
column of it can clash with its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.shared import documents, whole_row
from trawl.scratch import materialise

TEMPERATURE = 0.5
KEEP = 0.7
ROUNDS = 60
MAX_CELLS = 100_000
SEED = 20240
MARGINS = ("source", "lang", "topic")
ABSENT = "\0"


def topic_of(text) -> F.Column:
    """A coarse topic by surface: legal, tabular, contact, else long or short prose."""
    return (
        F.when(text.contains("icense") | text.contains("rights reserved"), "legal")
        .when(text.contains(" | "), "tabular")
        .when(text.contains("@") | text.contains("+1 ("), "contact")
        .when(F.length(text) >= 2000, "long")
        .otherwise("short")
    )


def described(docs: DataFrame, topic: Callable[[F.Column], F.Column] = topic_of, columns: list[str] | None = None) -> DataFrame:
    """(document, id, source, lang, topic, tokens): document is the row of docs or these columns of it, topic(text) its topic."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        whole_row(docs, columns),
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit(ABSENT)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(ABSENT)).alias("lang"),
        F.coalesce(topic(text), F.lit(ABSENT)).alias("topic"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
    )


def shares(totals: np.ndarray, names: list[str], given: dict[str, float] | None, temperature: float) -> np.ndarray:
    """Target shares of the categories that have tokens."""
    raw = np.array([given.get(n, 0.0) for n in names]) if given else totals**temperature
    raw = np.where(totals > 0, raw, 0.0)
    return raw / raw.sum() if raw.sum() > 0 else np.where(totals > 0, 1.0, 0.0) / max(1, (totals > 0).sum())


def rake(cells: list[tuple[str, str, str, float]], targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temperature: float = TEMPERATURE, rounds: int = ROUNDS) -> np.ndarray:
    """The probability of each cell (three categories and tokens)."""
    have = np.array([c[3] for c in cells], float)
    if not have.sum():
        return np.ones(len(cells))
    codes, wanted = [], []
    for k, margin in enumerate(MARGINS):
        names = sorted({c[k] for c in cells})
        at = {n: i for i, n in enumerate(names)}
        code = np.array([at[c[k]] for c in cells])
        codes.append(code)
        wanted.append(shares(np.bincount(code, have), names, (targets or {}).get(margin), temperature) * keep * have.sum())
    x = keep * have
    for _ in range(rounds):
        for code, want in zip(codes, wanted, strict=True):
            now = np.bincount(code, x, minlength=len(want))
            x = np.minimum(have, x * np.divide(want, now, out=np.ones_like(want), where=now > 0)[code])
    return np.divide(x, have, out=np.ones_like(x), where=have > 0)


def rake_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temperature: float = TEMPERATURE, rounds: int = ROUNDS) -> DataFrame:
    """The same fit for any number of cells, as joins and sums; a margin's totals are read from a written table."""
    spark, wanted = cells.sparkSession, {}
    for margin in MARGINS:
        totals = cells.groupBy(margin).agg(F.sum("have").alias("t"))
        given = (targets or {}).get(margin)
        if given:
            chosen = spark.createDataFrame(list(given.items()), f"{margin} string, raw double")
            raw = totals.join(chosen, margin, "left").select(margin, F.when(F.col("t") > 0, F.coalesce("raw", F.lit(0.0))).otherwise(0.0).alias("raw"))
        else:
            raw = totals.select(margin, F.when(F.col("t") > 0, F.pow("t", F.lit(temperature))).otherwise(0.0).alias("raw"))
        total, tokens = raw.agg(F.sum("raw")).first()[0] or 1.0, cells.agg(F.sum("have")).first()[0] or 0.0
        wanted[margin] = materialise(raw.select(margin, (F.col("raw") / total * keep * tokens).alias("want")), "targets")
    now = cells.withColumn("x", F.col("have") * keep)
    for k in range(rounds):
        for margin in MARGINS:
            factor = now.groupBy(margin).agg(F.sum("x").alias("now")).join(wanted[margin], margin).select(margin, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(1.0).alias("f"))
            now = now.join(factor, margin).withColumn("x", F.least("have", F.col("x") * F.col("f"))).drop("f")
        now = materialise(now, f"raked-{k}")
    return now.select(*MARGINS, F.when(F.col("have") > 0, F.col("x") / F.col("have")).otherwise(1.0).alias("probability"))


def probabilities(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool]:
    """(cells with probability, whether they are few enough to be broadcast); rows as of `described`."""
    cells = materialise(rows.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("have")), "cells")
    if cells.count() > max_cells:
        return rake_table(cells, targets, keep), False
    found = sorted((r["source"], r["lang"], r["topic"], r["have"]) for r in cells.collect())
    fitted = rake(found, targets, keep) if found else []
    return rows.sparkSession.createDataFrame([(*c[:3], float(p)) for c, p in zip(found, fitted, strict=True)], "source string, lang string, topic string, probability double"), True


def draw(row_id) -> F.Column:
    """A number in [0, 1) that depends on the id and SEED."""
    return F.shiftrightunsigned(F.xxhash64(row_id, F.lit(SEED)), 11) * F.lit(2.0**-53)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, max_cells: int = MAX_CELLS, topic: Callable[[F.Column], F.Column] = topic_of, columns: list[str] | None = None) -> DataFrame:
    """(document, source, lang, topic, tokens, probability, kept): document is the row of docs, null categories are ABSENT.

    Where only some columns are asked for, and not the text, the rows are written so that texts are read once.
    """
    rows = described(docs, topic, columns)
    if columns is not None and "text" not in columns:
        rows = materialise(rows, "described")
    fitted, small = probabilities(rows.select(*MARGINS, "tokens"), targets, keep, max_cells)
    joined = rows.join(F.broadcast(fitted) if small else fitted, list(MARGINS))
    return joined.select("document", *MARGINS, "tokens", "probability", (draw(F.col("id")) < F.col("probability")).alias("kept"))


def op10_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept) for all documents."""
    out = mix(documents(spark, sf_dir), columns=["doc_id", "source", "lang"])
    return out.select("document.doc_id", "document.source", "document.lang", "topic", F.col("tokens").alias("n_tokens"), "probability", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sampled documents, with their own columns."""
    return mix(docs).filter("kept").select("document.*")
