"""Pluggable models: embedders, rerankers, graders and generators, with deterministic offline stand-ins.

The stand-ins are lexical; they make pipelines run and repeat, and are no measure of a trained model's quality.
"""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]{2,}|\w{2,}")


class Embedder(Protocol):
    name: str
    size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Grader(Protocol):
    def grade(self, query: str, texts: list[str]) -> list[int]: ...


class Generator(Protocol):
    def answer(self, prompt: str) -> str: ...


class Analyser(Protocol):
    def analyse(self, text: str) -> list[tuple[str, str]]: ...


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def model_folder(name: str) -> str:
    """A model's name as a folder name."""
    return name.replace("/", "_")


class HashedEmbedder:
    """Signed hashed bag of words, of unit length; a text without words is the zero vector."""

    def __init__(self, size: int = 384) -> None:
        self.size, self.name = size, f"hashed-{size}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        found = [words(t) for t in texts]
        # a word is hashed once, however often it occurs
        number = {w: k for k, w in enumerate(dict.fromkeys(w for ws in found for w in ws))}
        hashes = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in number], np.int64)
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in found])
        own = hashes[[number[w] for ws in found for w in ws]] if number else hashes
        np.add.at(out, (row, (own >> 1) % self.size), 1.0 - 2 * (own & 1))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


#: The universal parts of speech that the lemma pipeline keeps.
CONTENT_POS = ("NOUN", "VERB", "ADJ", "ADV")


class SurfaceAnalyser:
    """(lemma, part of speech) of each token by its surface: numbers, punctuation, words of one letter as particles, capitalised
    words as proper names, all other words as nouns; the lemma is the token in small letters."""

    _token = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]", re.UNICODE)

    def analyse(self, text: str) -> list[tuple[str, str]]:
        out = []
        for token in self._token.findall(text):
            if token[0] in "0123456789":
                kind = "NUM"
            elif not token[0].isalpha():
                kind = "PUNCT"
            else:
                kind = "PART" if len(token) == 1 else "PROPN" if token[0].isupper() else "NOUN"
            out.append((token.lower(), kind))
        return out


def lemma_column(text: Column, model: Analyser, stop: tuple[str, ...], keep: tuple[str, ...] = CONTENT_POS) -> Column:
    """The lemmas of a text whose part of speech is kept and which are no stop words, between spaces; null is the empty text."""

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda t: " ".join(lemma for lemma, kind in model.analyse(t or "") if lemma and kind in keep and lemma not in stop))

    return apply(text)


class OverlapReranker:
    """Share of the query's distinct words that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        asked = set(words(query))
        return [len(asked & set(words(t))) / len(asked) if asked else 0.0 for t in texts]


class OverlapGrader:
    """Relevance 0 to 4 by overlap."""

    def grade(self, query: str, texts: list[str]) -> list[int]:
        return [min(4, int(4 * s + 0.5)) for s in OverlapReranker().score(query, texts)]


class TemplateGenerator:
    """Answers with the context's first line; keeps the call path testable without a model."""

    def answer(self, prompt: str) -> str:
        return prompt.partition("Context: ")[2].split("\n", 1)[0]


def embed_column(text: Column, model: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def apply(s: pd.Series) -> pd.Series:
        return pd.Series(list(model.embed(s.fillna("").tolist()).astype(np.float32)))

    return apply(text)


def similarity_column(text: Column, query: str, model: Embedder) -> Column:
    """Cosine of the query's vector and that of each text; 0 where a text or the query has none."""
    asked = np.asarray(model.embed([query])[0], float)
    asked = asked / (np.linalg.norm(asked) or 1.0)

    @F.pandas_udf("double")
    def apply(s: pd.Series) -> pd.Series:
        v = np.asarray(model.embed(s.fillna("").tolist()), float).reshape(len(s), -1)
        norm = np.linalg.norm(v, axis=1)
        return pd.Series((v @ asked if len(s) else norm) / np.where(norm > 0, norm, 1.0))

    return apply(text)


def rerank_column(query: Column, text: Column, model: Reranker) -> Column:
    @F.pandas_udf("double")
    def apply(q: pd.Series, t: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=t.index)
        for one, rows in t.fillna("").groupby(q.fillna("")):
            out[rows.index] = model.score(one, rows.tolist())
        return out

    return apply(query, text)


def grade_column(query: Column, text: Column, model: Grader) -> Column:
    @F.pandas_udf("int")
    def apply(q: pd.Series, t: pd.Series) -> pd.Series:
        out = pd.Series(0, index=t.index)
        for one, rows in t.fillna("").groupby(q.fillna("")):
            out[rows.index] = [min(4, max(0, g)) for g in model.grade(one, rows.tolist())]
        return out

    return apply(query, text)


def answer_column(prompt: Column, model: Generator) -> Column:
    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda p: None if p is None else model.answer(p))

    return apply(prompt)
