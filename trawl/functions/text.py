"""Text functions as Column expressions: tokens, chunks, filters, prompts, previews."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the lemma pipeline.
STOP_WORDS = ("in", "ali", "da", "se", "je", "so", "za", "na", "s", "z", "kot", "ne", "pa", "to", "ki", "ob", "po", "od", "do", "a")
#: Lemmas that the keyword step drops; two-word entries can't match a single token.
LEMMA_BLACKLIST = ("prvi niz", "drugi niz", "tretji niz", "as", "blok")
#: Phrases that mark consent and search boilerplate.
BOILERPLATE = (
    "hitro in učinkovito iskanje željene vsebine",
    "nabor vsebine glede na iskano temo",
    "upravljavec vaših podatkov je pro plus",
    "uporabljamo piškotke",
    "partnerjev uporabljamo",
    "pravilniku o zasebnosti",
    "politiki piškotkov",
    "obdelavo podatkov",
    "oglaševanje in vsebina",
)
#: Terms of the keyword classes, in the order of the classes 1 to 5.
KEYWORD_CLASSES = (("trump",), ("ukrajin",), ("nogomet",), ("rusija", "rusk"), ("iran",))
#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_words(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case white-space tokens without stop words; stands in for a lemmatiser, which `lemmatise` may replace."""
    return F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda x: (x != "") & ~x.isin(*stop))


def drop_lemmas(text: Column, blacklist: tuple[str, ...] = LEMMA_BLACKLIST) -> Column:
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda x: (x != "") & ~x.isin(*blacklist)), " ")


def plain(text: Column) -> Column:
    return F.lower(F.translate(text, PUNCTUATION, ""))


def contains_any(text: Column, phrases: tuple[str, ...] = BOILERPLATE) -> Column:
    low = F.lower(F.trim(text))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def keyword_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(k)).cast("long") for k in keywords), F.lit(0).cast("long"))


def occurrences(text: Column, term: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def keyword_class(text: Column, classes: tuple[tuple[str, ...], ...] = KEYWORD_CLASSES) -> Column:
    """Number of the class with most occurrences, the first on ties; 0 without any."""
    counts = [sum((occurrences(text, t) for t in terms), F.lit(0).cast("long")) for terms in classes]
    top = F.greatest(*counts)
    out = F.when(top == 0, F.lit(0))
    for i, c in enumerate(counts, 1):
        out = out.when(c == top, F.lit(i))
    return out.cast("long")


def fixed_chunks(text: Column, size: int = 50) -> Column:
    """Consecutive runs of `size` characters, the last one shorter, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def sentences(text: Column) -> Column:
    """Split after . ! ? before white space; stands in for a trained splitter."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+", re.ASCII)
_SPACED = re.compile(r"\S+", re.ASCII)


def chunked(text: str | None, max_words: int, compat: bool) -> list[str] | None:
    """The chunks of one text, in one pass."""
    return None if text is None else gathered(_SENTENCE_END.split(text.strip(" ")), max_words, compat)


def gathered(parts: list[str], max_words: int, compat: bool = False) -> list[str]:
    """Sentences put together in order while they have max_words words at most."""
    done: list[str] = []
    now: list[str] = []
    size = 0
    for s in parts:
        if not s:
            continue
        n = sum(1 for _ in _SPACED.finditer(s))
        if size + n > max_words:
            if compat or now:
                done.append(" ".join(now))
            now, size = [], 0
        now.append(s)
        size += n
    return [*done, " ".join(now)] if now else done


def sentence_chunks(text: Column, max_words: int = 128, compat: bool = False) -> Column:
    """Sentences gathered greedily up to max_words; a longer sentence is a chunk of its own.

    With compat an over-long first sentence leaves an empty chunk before it. The fold over sentences is a pandas UDF: as an
    expression it copies the growing list at every sentence.
    """
    @F.pandas_udf("array<string>")
    def work(texts: pd.Series) -> pd.Series:
        return pd.Series([chunked(t, max_words, compat) for t in texts], dtype=object)

    return work(text)


def tfidf_text(title: Column, summary: Column, body: Column, intended: bool = False) -> Column:
    """Title and summary if there is one, else the body alone; `intended` joins all three."""
    if intended:
        return F.concat_ws(" ", title, summary, body)
    return F.when(summary.isNotNull(), F.concat(title, F.lit(" "), summary)).otherwise(F.concat(F.lit(" "), body))


def metadata_sentence(titles: Column, summaries: Column, keywords: Column, labels: Column | None = None) -> Column:
    """Labelled lists of distinct values in sorted order; empty where all lists are. Labels join the keywords as they are."""
    strip = lambda values, fix: F.filter(F.transform(values, lambda x: F.trim(fix(x))), lambda x: x.isNotNull() & (x != ""))
    clean = lambda values: F.array_sort(F.array_distinct(values))
    t = clean(strip(titles, lambda x: F.replace(x, F.lit("_"), F.lit(" "))))
    s = clean(strip(summaries, lambda x: F.replace(x, F.lit("..."), F.lit(""))))
    k = strip(keywords, lambda x: F.replace(x, F.lit("-"), F.lit(" ")))
    k = clean(k if labels is None else F.concat(k, strip(labels, lambda x: x)))
    part = lambda label, values, between: F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, between), F.lit(".")))
    return F.concat_ws(" ", part("Naslovi", t, ". "), part("Povzetki", s, ". "), part("Ključne besede", k, ", "))


def preview(text: Column, size: int = 120) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def folder_name(query: Column, size: int = 60) -> Column:
    return F.translate(F.left(query, F.lit(size)), " /\\", "___")


def numbered_passages(texts: Column, size: int = 2000) -> Column:
    """[1] first, [2] second and so on, each cut to size, between blank lines."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.left(t, F.lit(size)))), "\n\n")


def rag_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Answer the following question using context.\nContext: "), context, F.lit("\nQuestion: "), question)


def curve_label(embedding: Column, enabled: Column, reranker: Column, file: Column | None = None) -> Column:
    label = F.when(enabled & reranker.isNotNull(), F.concat(embedding, F.lit(" + "), reranker)).otherwise(embedding)
    if file is None:
        return label
    return F.concat(label, F.lit(" - "), F.replace(F.regexp_replace(file, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")), F.lit(" distance"))


def bow_cosine(a: Column, b: Column) -> Column:
    """Cosine of word counts of two token lists."""
    counts = lambda t: F.transform(F.array_distinct(t), lambda w: F.struct(w.alias("w"), F.size(F.filter(t, lambda x: x == w)).cast("double").alias("n")))
    size = lambda t: F.sqrt(F.aggregate(counts(t), F.lit(0.0), lambda s, x: s + x["n"] * x["n"]))
    dot = F.aggregate(counts(a), F.lit(0.0), lambda s, x: s + x["n"] * F.size(F.filter(b, lambda y: y == x["w"])))
    return F.coalesce(F.try_divide(dot, size(a) * size(b)), F.lit(0.0))


def bow_priority(query: str, texts: list[Column]) -> Column:
    """The sum of the cosines of the query and each text by word counts; a null text has no words.

    A vocabulary over all the texts at once gives the same cosines, since words that neither of two texts has add nothing.
    """
    asked = tokens(F.lit(query))
    out = F.lit(0.0)
    for text in texts:
        out = out + bow_cosine(tokens(F.coalesce(text, F.lit(""))), asked)
    return out
