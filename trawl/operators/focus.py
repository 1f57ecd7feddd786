"""Relevance of pages by a Bayesian classifier over their words, for focused crawling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions import text as X

#: Terms of the classifier, the most frequent ones of the training texts.
MOST_TERMS = 5000


@dataclass(frozen=True)
class Classifier:
    """Classes with their log priors and the log probability of a term that a class does not have, and a table (term, logs)."""

    classes: list[str]
    priors: list[float]
    unseen: list[float]
    terms: DataFrame


def train(docs: DataFrame, label: str, text: str, most: int = MOST_TERMS) -> Classifier:
    """Multinomial naive Bayes with one added to each count; classes are few, terms `most` at most, so both are bounded."""
    known = docs.filter(F.col(label).isNotNull())
    counts = known.select(F.col(label).cast("string").alias("c"), F.explode(X.tokens(F.col(text))).alias("term")).groupBy("c", "term").agg(F.count("*").alias("n"))
    vocabulary = counts.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(most).select("term")
    kept = counts.join(F.broadcast(vocabulary), "term")
    size = vocabulary.count()
    rows = known.groupBy(F.col(label).cast("string").alias("c")).agg(F.count("*").alias("docs"))
    found = rows.join(kept.groupBy("c").agg(F.sum("n").alias("total")), "c", "left").select("c", "docs", F.coalesce("total", F.lit(0)).alias("total"))
    import math

    told = sorted((r["c"], r["docs"], r["total"]) for r in found.collect())
    every = sum(d for _, d, _ in told)
    totals = [t + size for _, _, t in told]
    one = [F.log((F.coalesce(F.max(F.when(F.col("c") == c, F.col("n"))), F.lit(0)) + 1.0) / F.lit(float(t))) for (c, _, _), t in zip(told, totals, strict=True)]
    terms = kept.groupBy("term").agg(F.array(*one).alias("logs")) if told else kept.select("term", F.array().cast("array<double>").alias("logs"))
    return Classifier([c for c, _, _ in told], [math.log(d / every) for _, d, _ in told], [math.log(1 / t) if t else 0.0 for t in totals], terms)


def relevance(pages: DataFrame, key: str, text: str, model: Classifier, wanted: tuple[str, ...]) -> DataFrame:
    """(key, relevance, in_focus): the probability of the wanted classes together, which a soft focus takes as the priority of
    the page's links, and whether the likeliest class is one of them, without which a hard focus follows none."""
    words = pages.select(key, F.explode(X.tokens(F.col(text))).alias("term"))
    # a page's hits are summed in its own task as far as may be; the table of terms has MOST_TERMS rows
    hits = words.join(F.broadcast(model.terms), "term")
    sums = hits.groupBy(F.col(key).alias("_k")).agg(*[F.sum(F.get("logs", i)).alias(f"_s{i}") for i in range(len(model.classes))])
    full = pages.select(key).join(sums, F.col(key) == F.col("_k"), "left")
    logs = F.array(*[F.coalesce(f"_s{i}", F.lit(0.0)) + p for i, p in enumerate(model.priors)])
    scaled = full.select(key, logs.alias("_l")).select(key, "_l", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))).alias("_e"))
    mine = [i for i, c in enumerate(model.classes) if c in wanted]
    total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    part = sum((F.get("_e", i) for i in mine), F.lit(0.0))
    best = F.array_position("_l", F.array_max("_l")) - 1
    return scaled.select(key, F.try_divide(part, total).alias("relevance"), best.isin(*mine).alias("in_focus"))
