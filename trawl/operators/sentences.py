"""A sentence splitter that learns from the texts that it splits (after Kiss and Strunk, 2006), without labels.

A first aggregate counts for each word how often it stands with and without a period; a log-likelihood ratio, scaled by
length, inner periods and occurrences without one, says which words are abbreviations. A second one, which knows these,
counts what follows a sentence's end; a ratio of the same kind says which words start sentences. The model is all words of
either kind. Up to CARRIED of them go to the tasks that split; beyond that texts meet the words that they hold by joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import gathered
from trawl.scratch import materialise

#: The published thresholds of abbreviations and of sentence starters.
ABBREVIATION, STARTER = 0.3, 30.0
#: Words of a model that tasks carry; a larger one is joined.
CARRIED = 100_000
#: White space between words, the characters that stand around a word without being part of it, and patterns of these.
SPACE, BEFORE, AFTER = r"[ \t\n\x0B\f\r]+", "(\"'[«„“", ")\"']»”,;:"
LEAD, TRAIL = f"^[{re.escape(BEFORE)}]+", f"[{re.escape(AFTER)}]+$"


@dataclass(frozen=True)
class Model:
    abbreviations: frozenset[str]
    starters: frozenset[str]


def words(text: Column) -> Column:
    """The words of a text, without what stands around them."""
    bare = F.transform(F.split(text, SPACE), lambda w: F.rtrim(F.ltrim(w, F.lit(BEFORE)), F.lit(AFTER)))
    return F.filter(bare, lambda w: w != "")


def kind_of(word: Column) -> Column:
    """A word in lower case without its last period."""
    return F.lower(F.when(F.endswith(word, F.lit(".")), F.left(word, F.length(word) - 1)).otherwise(word))


def _safe(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(kind, ended, open): how often a kind of word has a period at its end and how often not."""
    every = docs.select(F.explode(words(F.col(text))).alias("w")).select(kind_of(F.col("w")).alias("kind"), F.endswith("w", F.lit(".")).cast("long").alias("e"))
    return every.groupBy("kind").agg(F.sum("e").alias("ended"), F.sum(1 - F.col("e")).alias("open"))


def with_periods(counts: DataFrame) -> DataFrame:
    """Rows of word_counts with `total` and `periods`, both over all words; kinds that have a period and hold a letter."""
    whole = counts.agg(F.sum(F.col("ended") + F.col("open")).alias("total"), F.sum("ended").alias("periods"))
    # one row of two numbers
    return counts.filter((F.col("ended") > 0) & F.col("kind").rlike(r"\p{L}")).join(F.broadcast(whole), F.lit(True))


def period_counts(docs: DataFrame, text: str) -> DataFrame:
    """(kind, ended, open, total, periods) of the words of docs."""
    return with_periods(word_counts(docs, text))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """(kind, ended, open, score); ABBREVIATION or more makes an abbreviation."""
    k, m, p = F.col("ended"), F.col("open"), _safe(F.col("periods") / F.col("total"))
    ratio = -2 * (k * F.log(p) + m * F.log(1 - p) - k * F.log(F.lit(0.99)) - m * F.log(F.lit(0.01)))
    inner = F.length("kind") - F.length(F.replace("kind", F.lit("."), F.lit("")))
    length = (F.length("kind") - inner).cast("double")
    # a letter is there, so the length is one at least
    return counts.select("kind", "ended", "open", (ratio * F.exp(-length) * (inner + 1) * F.exp(-m * F.log(length))).alias("score"))


def starter_counts(docs: DataFrame, text: str, counts: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """(kind, first, seen, total, ends): how often a kind of word follows a period that ends a sentence, and how often it is
    there; both over all words. counts are the docs' word_counts, abbreviations holds their kinds."""
    pairs = docs.select(words(F.col(text)).alias("w")).select(F.explode(F.arrays_zip(F.col("w").alias("word"), F.concat(F.array(F.lit("")), F.col("w")).alias("before"))).alias("p"))
    after = pairs.select("p.*").filter(F.col("word").isNotNull() & F.endswith("before", F.lit(".")))
    told = after.select(kind_of(F.col("word")).alias("kind"), kind_of(F.col("before")).alias("_k")).filter(~F.col("_k").rlike(r"^(\p{L}|\p{N}+)$"))
    # pairs of kinds are counted before they meet the abbreviations
    ends = told.groupBy("kind", "_k").agg(F.count("*").alias("_n")).join(abbreviations.select(F.col("kind").alias("_k")), "_k", "left_anti")
    firsts = ends.groupBy("kind").agg(F.sum("_n").alias("first"))
    met = counts.select("kind", (F.col("ended") + F.col("open")).alias("seen")).join(firsts, "kind", "left")
    whole = met.agg(F.sum("seen").alias("total"), F.sum("first").alias("ends"))
    return met.filter((F.col("first") > 0) & F.col("kind").rlike(r"^\p{L}")).join(F.broadcast(whole), F.lit(True))


def starter_scores(counts: DataFrame) -> DataFrame:
    """(kind, first, seen, score): the log-likelihood ratio of a kind being as frequent after a sentence's end as elsewhere;
    STARTER or more, for what is more frequent there, makes a starter."""
    n, ends, seen, first = (F.col(c) for c in ("total", "ends", "seen", "first"))
    likely = lambda k, m, p: k * F.log(_safe(p)) + (m - k) * F.log(1 - _safe(p))
    p, p1, p2 = seen / n, first / ends, F.coalesce(F.try_divide(seen - first, n - ends), F.lit(0.0))
    ratio = -2 * (likely(first, ends, p) + likely(seen - first, n - ends, p) - likely(first, ends, p1) - likely(seen - first, n - ends, p2))
    return counts.select("kind", "first", "seen", F.when(p1 > p, ratio).otherwise(0.0).alias("score"))


def learnt(docs: DataFrame, text: str) -> DataFrame:
    """(kind, short, starts), written: every kind of word that is an abbreviation or starts sentences."""
    counts = materialise(word_counts(docs, text), "words")
    abbreviations = materialise(abbreviation_scores(with_periods(counts)).filter(F.col("score") >= ABBREVIATION).select("kind"), "abbreviations")
    starters = starter_scores(starter_counts(docs, text, counts, abbreviations)).filter(F.col("score") >= STARTER)
    both = abbreviations.select("kind", F.lit(True).alias("short"), F.lit(False).alias("starts")).union(starters.select("kind", F.lit(False), F.lit(True)))
    return materialise(both.groupBy("kind").agg(F.max("short").alias("short"), F.max("starts").alias("starts")), "model")


def carried(found: DataFrame) -> Model:
    """The rows of learnt as one object."""
    rows = found.collect()
    return Model(frozenset(r["kind"] for r in rows if r["short"]), frozenset(r["kind"] for r in rows if r["starts"]))


def learn(docs: DataFrame, text: str) -> Model:
    """The whole model as one object, for texts whose model a task may hold; `learned_chunks` needs none."""
    return carried(learnt(docs, text))


_WORD = re.compile(r"[^ \t\n\x0B\f\r]+")


def _found(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, word) of each run of other than white space, the word without what stands around it."""
    return [(m.start(), m.end(), m[0].lstrip(BEFORE).rstrip(AFTER)) for m in _WORD.finditer(text or "")]


def _after(word: str) -> str:
    return word.removesuffix(".").lower()


def asked(text: str | None) -> set[str]:
    """The kinds of word whose place in a model decides how the text is split."""
    found, out = _found(text), set()
    for k, (_, _, word) in enumerate(found):
        if word.endswith(".") and not word.endswith("..."):
            out.add(word[:-1].lower())
            if k + 1 < len(found):
                out.add(_after(found[k + 1][2]))
    return out


def split(text: str | None, model: Model) -> list[str]:
    """The sentences of a text, each as it stands there.

    `!` and `?` end one, and so does a period, but after an abbreviation, a single letter or a number only where a capital
    starts a word that starts sentences, and after an ellipsis only before a capital.
    """
    found = _found(text)
    out, start = [], None
    for k, (a, b, word) in enumerate(found):
        start = a if start is None else start
        if not word.endswith(("!", "?", ".")):
            continue
        after = found[k + 1][2] if k + 1 < len(found) else ""
        capital = after[:1].isupper()
        kind = word[:-1].lower()
        if word.endswith(("!", "?")):
            ends = True
        elif word.endswith("..."):
            ends = capital
        else:
            short = kind in model.abbreviations or (len(kind) == 1 and kind.isalpha()) or kind.isdigit()
            ends = not short or (capital and _after(after) in model.starters)
        if ends:
            out.append(text[start:b])
            start = None
    return out if start is None else [*out, text[start : found[-1][1]]]


def sentences_column(text: Column, model: Model) -> Column:
    @F.pandas_udf("array<string>")
    def work(texts: pd.Series) -> pd.Series:
        return pd.Series([split(t, model) for t in texts], dtype=object)

    return work(text)


def chunks_column(text: Column, model: Model, max_words: int = 128) -> Column:
    """Sentences gathered greedily up to max_words; null stays null."""
    @F.pandas_udf("array<string>")
    def work(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else gathered(split(t, model), max_words) for t in texts], dtype=object)

    return work(text)


def joined_chunks(docs: DataFrame, text: str, found: DataFrame, chunks: str, max_words: int = 128) -> DataFrame:
    """docs with the chunks that chunks_column has, by the rows of learnt however many they are: each different text meets its
    kinds of word, and takes those of them that the model holds."""

    @F.pandas_udf("array<string>")
    def kinds(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(asked(t)) for t in texts], dtype=object)

    @F.pandas_udf("array<string>")
    def work(texts: pd.Series, shorts: pd.Series, starts: pd.Series) -> pd.Series:
        few = zip(texts, shorts, starts, strict=True)
        none = lambda x: frozenset(() if x is None else x)
        return pd.Series([None if t is None else gathered(split(t, Model(none(a), none(b))), max_words) for t, a, b in few], dtype=object)

    # a text's digest stands for it, so that no id has to
    keyed = docs.withColumn("_text", F.sha2(text, 256))
    pairs = materialise(keyed.filter(F.col(text).isNotNull()).select("_text", F.explode(kinds(F.col(text))).alias("kind")).distinct(), "asked")
    met = pairs.join(found, "kind").groupBy("_text").agg(F.collect_set(F.when(F.col("short"), F.col("kind"))).alias("_shorts"), F.collect_set(F.when(F.col("starts"), F.col("kind"))).alias("_starts"))
    whole = keyed.join(met, "_text", "left")
    return whole.withColumn(chunks, work(F.col(text), F.col("_shorts"), F.col("_starts"))).drop("_text", "_shorts", "_starts")


def with_chunks(docs: DataFrame, text: str, chunks: str, max_words: int = 128) -> DataFrame:
    """docs with the chunks of their texts by a splitter that learns from all of them."""
    found = learnt(docs, text)
    if found.limit(CARRIED + 1).count() <= CARRIED:
        return docs.withColumn(chunks, chunks_column(F.col(text), carried(found), max_words))
    return joined_chunks(docs, text, found, chunks, max_words)
