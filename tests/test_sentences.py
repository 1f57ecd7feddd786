"""The learning splitter against plain loops, and on a made-up corpus with abbreviations."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import pytest

from trawl.operators import sentences as S


def words(text):
    bare = [re.sub(S.TRAIL, "", re.sub(S.LEAD, "", w)) for w in re.split(S.SPACE, text or "")]
    return [w for w in bare if w]


def kind(word):
    return word.removesuffix(".").lower()


def model_by_loops(texts):
    ended, free, n = Counter(), Counter(), 0
    for t in texts:
        for w in words(t):
            (ended if w.endswith(".") else free)[kind(w)] += 1
            n += 1
    p, short = sum(ended.values()) / n, {}
    for w, k in ended.items():
        if any(c.isalpha() for c in w):
            m, dots = free[w], w.count(".")
            ratio = -2 * (k * math.log(p) + m * math.log(1 - p) - k * math.log(0.99) - m * math.log(0.01))
            short[w] = ratio * math.exp(-(len(w) - dots)) * (dots + 1) * math.exp(-m * math.log(len(w) - dots))
    abbreviations = {w for w, s in short.items() if s >= S.ABBREVIATION}
    seen, first, ends = Counter(), Counter(), 0
    for t in texts:
        own = words(t)
        for before, w in zip(["", *own], own, strict=False):
            seen[kind(w)] += 1
            b = kind(before)
            if before.endswith(".") and b not in abbreviations and not re.fullmatch(r"[^\W\d_]|\d+", b):
                first[kind(w)] += 1
                ends += 1

    def likely(k, m, q):
        q = min(max(q, 1e-9), 1 - 1e-9)
        return k * math.log(q) + (m - k) * math.log(1 - q)

    starters = set()
    for w, k in first.items():
        q, q1, q2 = seen[w] / n, k / ends, (seen[w] - k) / (n - ends)
        ratio = -2 * (likely(k, ends, q) + likely(seen[w] - k, n - ends, q) - likely(k, ends, q1) - likely(seen[w] - k, n - ends, q2))
        if w[0].isalpha() and q1 > q and ratio >= S.STARTER:
            starters.add(w)
    return short, abbreviations, starters


def corpus(n, seed=3):
    """Texts of known sentences with abbreviations inside."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("ran", "dol", "sit", "mek", "pul")]
    out = []
    for _ in range(n):
        sentences = []
        for _ in range(rng.randint(3, 8)):
            own = [rng.choice(vocabulary) for _ in range(rng.randint(5, 12))]
            for _ in range(2):
                own.insert(rng.randrange(1, len(own)), rng.choice(["dr.", "npr.", "t.i.", "ul."]) + " " + rng.choice(["Novak", "loran", "Pirc"]))
            first = rng.choice(["Danes", "Potem", "Vendar"])
            sentences.append(f"{first} {' '.join(own)}{rng.choice(['.', '.', '.', '!', '?'])}")
        out.append(sentences)
    return out


@pytest.fixture(scope="module")
def learnt(spark):
    texts = [" ".join(s) for s in corpus(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", " . "])], "id int, text string")
    return texts, docs, S.learn(docs, "text")


def test_model_equals_loops(learnt):
    texts, docs, model = learnt
    short, abbreviations, starters = model_by_loops([*texts, " . "])
    got = {r["kind"]: r["score"] for r in S.abbreviation_scores(S.period_counts(docs, "text")).collect()}
    assert got.keys() == short.keys() and all(abs(got[w] - s) <= 1e-9 * max(1, abs(s)) for w, s in short.items())
    assert model.abbreviations == abbreviations == {"dr", "npr", "t.i", "ul"} and model.starters == starters >= {"danes", "potem", "vendar"}


def test_abbreviations_are_not_split(learnt, spark):
    _, _, model = learnt
    for sentences in corpus(60, seed=11):
        assert S.split(" ".join(sentences), model) == sentences
    assert S.split(None, model) == [] == S.split("  ", model)
    assert S.split('Danes je dr. Novak "doma." Potem gre... domov. Ob 3. uri npr. Vendar ne!', model) == ['Danes je dr. Novak "doma."', "Potem gre... domov.", "Ob 3. uri npr.", "Vendar ne!"]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "Danes je dr. Novak tu. Potem gre."), (2, None)], "id int, text string")
    got = {r["id"]: r["c"] for r in rows.select("id", S.chunks_column(F.col("text"), model, 5).alias("c")).collect()}
    assert got == {1: ["Danes je dr. Novak tu.", "Potem gre."], 2: None}


def test_models_are_whole(spark, tmp_path, monkeypatch):
    """More abbreviations than 10,000 all count, and a model that tasks don't carry gives the same chunks by joins."""
    from trawl.functions.text import gathered
    from trawl.plans import text_queries

    kinds = ["".join(c) for c in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=3), 10_400)]
    texts = [" ".join(f"{'vsebina ' * 40}{k}. drugi" for k in kinds[i : i + 20]) for i in range(0, len(kinds), 20)]
    texts += [" ".join(s) for s in corpus(60)] + ["", " . "]
    short, abbreviations, starters = model_by_loops(texts)
    assert len(abbreviations) > 10_000 and "danes" in starters
    model = S.Model(frozenset(abbreviations), frozenset(starters))
    want = sorted((i, k, c) for i, t in enumerate(texts) for k, c in enumerate(gathered(S.split(t, model), 128)))
    rows = [*enumerate(texts), (len(texts), None), (None, texts[-3]), (None, texts[-3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for most in (S.CARRIED, 100):
        monkeypatch.setattr(S, "CARRIED", most)
        got = [tuple(r) for r in text_queries.learned_chunks(spark, str(tmp_path)).collect()]
        assert sorted(r for r in got if r[0] is not None) == want
        copies = [r[1:] for r in got if r[0] is None]
        assert sorted(copies) == sorted(2 * [r[1:] for r in want if r[0] == len(texts) - 3])
