"""The n-gram join against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from trawl.llm import near_dedup, ngram_join


def joined_by_force(rows, words=3, percent=90):
    """[(doc_id, size, component)] sorted; components are over rows, so ids may repeat."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def edited(words, rng, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_join_of_test_data(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(ngram_join.joined(docs)) == joined_by_force([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize(("block", "percent"), [(8, 90), (512, 80)])
def test_join_of_groups(make, block, percent, monkeypatch):
    """Chains of edits around the threshold, a passage that most texts share, sizes one apart and short texts."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(percent)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, edited(base, rng, rng.randint(1, 6))) for i in range(70)]
    for i in range(70, 100):  # each an edit of the one before
        base = edited(base, rng, 2).split()
        rows.append((i, " ".join(base)))
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [(100 + i, passage + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60)))) for i in range(40)]
    rows += [(200 + i, " ".join("abc"[rng.randrange(3)] for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(300 + i, " ".join(f"q{k}" for k in range(11 + i))) for i in range(6)]
    rng.shuffle(rows)
    assert got(ngram_join.joined(make(rows), percent=percent)) == joined_by_force(rows, percent=percent)


def test_join_edges(make, edges):
    rows = [*edges, (9, "Short"), (10, "one two"), (11, "ONE two"), (12, " \n "), (13, "long words " * 5), (None, "nobody knows this"), (None, "nobody knows this")]
    assert got(ngram_join.joined(make(rows))) == joined_by_force(rows)
    assert ngram_join.joined(make([])).count() == 0


def test_filters_lose_no_pair():
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 4, ngram_join.SLOTS).astype(np.uint8)
    for percent in (80, 90):
        for _ in range(300):
            n = int(rng.integers(1, 200))
            a = np.unique(near_dedup.mix64(rng.integers(0, 10**6, n).astype(np.uint64)))
            cut, more = (int(rng.integers(0, max(1, len(a) // 8) + 1)) for _ in range(2))
            b = np.unique(np.concatenate([a[cut:], near_dedup.mix64(rng.integers(10**7, 10**8, more).astype(np.uint64))]))
            if not len(b):
                continue
            linked = 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
            lists = [[np.sort(r)[: int(ngram_join.prefix_sizes(np.array(len(x)), percent))] for r in ngram_join.ranks(x, levels)] for x in (a, b)]
            alone = all(ngram_join.differing(x, y) <= ngram_join.differences_allowed(len(a), len(b), percent) for x, y in zip(*lists, strict=True))
            fine = bool(ngram_join.block_candidates(np.array([len(a), len(b)]), [list(p) for p in zip(*lists, strict=True)], np.array([0]), np.array([1]), percent)[0, 0])
            assert not linked or (alone and fine and len(np.intersect1d(lists[0][0], lists[1][0])))
            assert fine == (alone and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)))


def test_sets_are_distinct():
    import pyarrow as pa

    from trawl.llm.shared import byte_column

    elements, bounds = ngram_join.sets(*byte_column(pa.array(["a b c a b c a", "", "x y", "A b C"])), 3)
    assert np.diff(bounds).tolist() == [3, 0, 1, 1] and Counter(elements.tolist())[int(elements[-1])] == 2
