"""Filter audit and manifest against brute force on edge cases; they and the n-gram join against SQL."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import permutations

import pytest

from tests.oracle import compare, connect
from trawl.llm import filter_audit, manifest, queries

# filter audit


def audit_by_force(rows, good, toxic):
    """rows are (doc_id, text, lang); good and toxic are sets of ids."""
    failing = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j, u, _ in rows if (u or "") == t and j is not None]
        failing.append((lang or "", i, {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and min(same) < i,
        }))
    out = {}
    for part in {p for p, _, _ in failing}:
        own = [(i, f) for p, i, f in failing if p == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for k, letter in enumerate(order, 1):
                removed = [(i, f) for i, f in left if f[letter]]
                left = [(i, f) for i, f in left if not f[letter]]
                out[part, "".join(order), k] = [
                    len(left), len(removed), sum(f[letter] for _, f in own) - len(removed), sum(f[letter] and sum(f.values()) == 1 for _, f in own),
                    sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed),
                ]
    for (part, order, k), row in out.items():
        row.append(sum(v[1] for (p, o, j), v in out.items() if p == part and o[j - 1] == order[k - 1] and len(v) >= 6))
    return out


def test_filter_audit_edges(spark, make, edges):
    from pyspark.sql import functions as F

    many = [*edges, (20, "LOUD WORDS " * 80), (21, "LOUD WORDS " * 80), (22, "a # sign"), (23, " ".join(f"w{i}" for i in range(120))), (24, " ".join(f"w{i}" for i in range(120)) + " $")]
    lang = F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "").otherwise("en")
    docs = make(many).withColumn("lang", lang)
    labels = spark.createDataFrame([(2, 1, 0), (3, 1, 1), (20, 0, 1), (20, 0, 1), (21, None, 1), (23, 1, 0), (77, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(docs, labels).collect()}
    rows = [(i, t, None if i is not None and i % 3 == 0 else "" if i is not None and i % 3 == 1 else "en") for i, t in many]
    assert got == audit_by_force(rows, {2, 3, 23}, {3, 20, 21})


def test_filter_audit_of_nothing(spark, make):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(make([]), labels).count() == 0
    out = filter_audit.audit(make([(1, None)]), labels)
    assert out.count() == 600 and out.filter("shapley > 0").select("filter_order").distinct().count() == 120


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """(root, for each node its path of (sibling, is the sibling left))"""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            path.append((level[i ^ 1] if i ^ 1 < len(level) else "", i % 2 == 1))
            i //= 2
        paths.append(path)
    return levels[-1][0], paths


def manifest_by_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_by_hand(r)))
        trees[name] = tree([leaf_by_hand(r) for r in groups[name]])
    root, over = tree([trees[n][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            path = trees[name][1][i] + over[k]
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf_by_hand(r, int(bad))
            for sibling, left in path:
                now = h(sibling, now) if left else h(now, sibling)
            out.append((r["doc_id"], leaf_by_hand(r), trees[name][0], root, h(*[s for s, _ in path]), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 9])
def test_manifest_by_force(spark, make, edges, height, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(manifest, "HEIGHT", height)
    rows = [*edges, *[(i, f"text {i}") for i in range(30, 67 if height > 1 else 43)], (-4, "negative")]
    lang = F.when(F.col("doc_id") < 3, None).when(F.col("doc_id") < 7, "").when(F.col("doc_id") == 30, "é").when(F.col("doc_id") % 5 == 0, "de").otherwise("en")
    docs = make(rows).withColumn("lang", lang).withColumn("n_chars", F.when(F.col("doc_id") % 4 > 0, F.col("n_chars"))).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    got = manifest.manifest(docs)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    found = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    assert found == manifest_by_force([r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert any(not r[-1] for r in found)


def test_manifest_of_little(make):
    assert manifest.manifest(make([])).count() == 0
    (one,) = manifest.manifest(make([(1, None)])).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == h() and one["verified"]


@pytest.mark.parametrize("name", ["op11_ngram_join", "op12_merkle_manifest", "op13_filter_audit"])
def test_matches_sql(spark, sf, name):
    compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])
