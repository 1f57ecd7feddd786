"""Queries held against brute force over all rows, on small tables with copies."""

from __future__ import annotations

import base64
import itertools
import math
import threading
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.catalog import load
from trawl.functions import fuzzy
from trawl.operators import blocks, clustering, likeness, textstats

QUERIES = load().callables()


def test_fuzzy_similar_covers_every_document(spark, tmp_path):
    words = [f"word{i * 7919 % 613}" for i in range(260)]
    base, other = " ".join(words), " ".join(f"other{i * 31 % 97}" for i in range(200))
    texts = [base] * 4 + [" ".join([*words[:200], "changed", *words[201:]])] * 3 + [other, other, "short", "short", "", None, base]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in QUERIES["fuzzy_similar"](spark, str(tmp_path)).collect()}
    check_likeness(rows, docs)
    assert rows[12]["class_id"] is None and len({rows[i]["class_id"] for i in (0, 1, 2, 3, 13)}) == 1


def check_likeness(rows, docs):
    """Classes, links and best partners against all pairs."""
    assert sorted(rows) == [i for i, _ in docs]
    hashes: dict[str, list[int]] = {}
    for i, t in docs:
        if t is not None:
            hashes.setdefault(fuzzy.fuzzy_hash(t), []).append(i)
    alike: dict[int, list[tuple[int, int]]] = {}
    for (h, a), (g, b) in itertools.combinations(hashes.items(), 2):
        if (n := fuzzy.hash_compare(h, g)) > 0:
            alike.setdefault(min(a), []).append((-n, min(b)))
            alike.setdefault(min(b), []).append((-n, min(a)))
    for h, members in hashes.items():
        own = alike.get(min(members), [])
        for i in members:
            best = min(own, default=(None, None))
            r = rows[i]
            assert (r["class_id"], r["own_likeness"], r["links"]) == (min(members), fuzzy.hash_compare(h, h), len(own))
            assert (r["best"], r["likeness"]) == (best[1], -best[0] if own else None)


def test_fuzzy_links_of_a_large_group(spark, tmp_path, monkeypatch):
    """Near copies that share most of their grams, in blocks of 16, and documents that are alike to none."""
    monkeypatch.setattr(likeness, "BLOCK", 16)
    rng = np.random.default_rng(2)
    words = [f"word{i * 7919 % 613}" for i in range(300)]
    texts = []
    for k in range(70):
        own = words.copy()
        own[rng.integers(0, 300)] = f"new{k}"
        texts.append(" ".join(own[: 300 - k % 3]))
    texts += [" ".join(f"w{rng.integers(0, 10**6)}" for _ in range(200)) for _ in range(10)]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in QUERIES["fuzzy_similar"](spark, str(tmp_path)).collect()}
    check_likeness(rows, docs)
    assert max(r["links"] for r in rows.values()) > 30


def test_bm25_scores_every_item(spark, tmp_path):
    docs = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(5 + i % 9))) for i in range(40)] + [(40, ""), (41, "?"), (42, None), (43, "w1 w2 W1"), (44, "w1 w2 W1")]
    items = [(i, " ".join(f"w{(i * 5 + j) % 29}" for j in range(4))) for i in range(9)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    counts = {i: Counter(t.lower().split()) for i, t in docs if t and t != "?"}
    average = sum(c.total() for c in counts.values()) / len(counts)
    want = {}
    for (q, text), (d, c) in itertools.product(items, counts.items()):
        score = 0.0
        for t in set(text.split()) & set(c):
            df = sum(t in x for x in counts.values())
            score += math.log(1 + (len(counts) - df + 0.5) / (df + 0.5)) * c[t] / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / average))
        if score:
            want[q, d] = score
    got = {(r["item_id"], r["doc_id"]): r["score"] for r in QUERIES["bm25_scores"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-5) and max(q for q, _ in got) == 8
    ranks = {(q, d): 1 + sum(round(x, 9) > round(s, 9) for (p, _), x in want.items() if p == q) for (q, d), s in want.items()}
    top = {(r["item_id"], r["doc_id"]): r["score_rank"] for r in QUERIES["bm25_top10"](spark, str(tmp_path)).collect()}
    assert top == {k: r for k, r in ranks.items() if r <= 10}
    asked = spark.createDataFrame([(q, t) for q, text in items for t in set(text.split())], "item_id long, term string")
    joined = textstats.bm25_by_join(spark.read.parquet(str(tmp_path / "documents.parquet")), asked, "doc_id", "text", "item_id").collect()
    assert {(r["item_id"], r["doc_id"]): r["score"] for r in joined} == pytest.approx(want)


def vectors_of(n, dims=6, seed=5, copies=30):
    v = np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)
    v[:copies] = v[0]
    return v


def nearest(v, queries, n=10):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    return {(q, int(i), r) for q in queries for r, i in enumerate(np.lexsort((np.arange(len(v)), np.round(1 - u @ u[q], 12)))[:10], 1)}


def test_nearest_and_relevance_of_every_segment(spark, tmp_path):
    v = vectors_of(130)
    spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {tuple(r) for r in QUERIES["batch_knn"](spark, str(tmp_path)).collect()}
    assert got == nearest(v, range(0, 130, 20))
    rows = QUERIES["same_page_relevance"](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["id"], r["rank"]) for r in rows} == nearest(v, range(0, 130, 20))
    assert all(r["relevant"] == (r["query_id"] // 10 == r["id"] // 10) for r in rows)
    table = spark.read.parquet(str(tmp_path / "embeddings.parquet")).withColumnRenamed("vec_id", "id")
    small = blocks.nearest_for_all(table, table, 10, size=16).select("query_id", "id", "rank").collect()
    assert {tuple(r) for r in small} == nearest(v, range(130))


def test_mmr_picks_from_all_rows_of_a_group(spark):
    v = vectors_of(160, copies=120)
    relevance = [1.0] * 120 + [0.9 - i / 100 for i in range(40)]
    rows = [(g, i, relevance[i], [float(x) for x in v[i]]) for g, size in ((0, 160), (1, 3), (2, 1)) for i in range(size)]
    frame = spark.createDataFrame(rows, "g int, id long, r double, v array<double>").repartition(5)
    got = {(r["g"], r["pick"]): r["id"] for r in clustering.mmr_by_group(frame, "g", "id", "r", "v", 6).collect()}
    want = {}
    for g, size in ((0, 160), (1, 3), (2, 1)):
        for n, i in enumerate(clustering.mmr(relevance[:size], [x.tolist() for x in v[:size]], 6), 1):
            want[g, n] = i
    assert len({got[0, n] for n in range(1, 7)} & set(range(120, 160))) >= 4
    assert {k: i if i >= 120 else -1 for k, i in got.items()} == {k: i if i >= 120 else -1 for k, i in want.items()}
    assert len(got) == len(set((k[0], i) for k, i in got.items())) == 10


def test_keywords_go_on_until_enough_are_accepted(spark):
    long = [f"{'a' * n}" for n in range(1, 90)]
    counts = [(label, t, 1000 - len(t)) for label in (0, 1) for t in long] + [(label, t, 5) for label in (0, 1) for t in ("b", "c", "d", "e", "f", "g")]
    frame = spark.createDataFrame(counts, "label int, term string, tf long")
    got = textstats.cluster_keywords(frame, "label", 3, min_df=1).collect()
    assert {(r["label"], r["keyword_rank"], r["term"]) for r in got} == {(label, n, t) for label in (0, 1) for n, t in enumerate("abcdef")}


@pytest.mark.parametrize("most", [3, 8, 40, 10_000])
def test_keywords_without_terms_that_cannot_matter(spark, sf, most):
    """The same keywords as from all n-grams, from fewer counts where the vocabulary is full."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 5 = 0").withColumn("label", F.pmod(F.hash("lang"), F.lit(97)))
    docs = docs.unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(9).withColumn("label", F.lit(-1)))
    clusters = docs.select("label").filter("label <> -1").distinct().count()
    every = textstats.cluster_term_counts(docs, "label", "text").cache()
    few = textstats.keyword_term_counts(docs, "label", "text", clusters, max_features=most)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(textstats.cluster_keywords(few, "label", clusters, max_features=most)) == rows(textstats.cluster_keywords(every, "label", clusters, max_features=most))
    assert few.exceptAll(every).isEmpty()
    assert few.count() < 0.7 * every.count() or most == 10_000
    every.unpersist()


def silhouettes(d, labels):
    out = []
    for i, c in enumerate(labels):
        own = [d[i, j] for j in range(len(labels)) if j != i and labels[j] == c]
        near = [np.mean(d[i, labels == x]) for x in set(labels.tolist()) - {c}]
        a, b = np.mean(own) if own else 0.0, min(near, default=0.0)
        out.append((b - a) / max(a, b) if own and near and max(a, b) > 0 else 0.0)
    return np.array(out)


def test_silhouette_has_no_limit(spark):
    frame = spark.range(5200).select("id", (F.col("id") % 3).cast("int").alias("label"), F.array(F.cos(F.col("id") % 3 + F.rand(1)), F.sin(F.col("id") % 3 + F.rand(2))).alias("v"))
    assert clustering.exact_silhouette(frame, "label", "v").count() == 5200


def test_silhouettes_equal_all_pairs(spark):
    v = vectors_of(90, copies=5).astype(float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    one, two = np.arange(90) % 4, np.where(np.arange(90) == 7, 2, np.arange(90) % 2)
    frame = spark.createDataFrame([(i, x.tolist(), y.tolist(), int(one[i]), int(two[i])) for i, (x, y) in enumerate(zip(v, u, strict=True))], "id long, v array<double>, u array<double>, one int, two int")
    for name, labels in (("one", one), ("two", two)):
        got = {r["id"]: r["silhouette"] for r in clustering.exact_silhouette(frame, name, "v").collect()}
        assert [got[i] for i in range(90)] == pytest.approx(silhouettes(1 - u @ u.T, labels), abs=1e-9)
    euclid = np.linalg.norm(u[:, None] - u[None, :], axis=2)
    both = frame.withColumn("labels", F.array("one", "two"))
    got = blocks.full_silhouettes(both, "id", "u", "labels", [4, 3], size=20)
    assert got == pytest.approx([silhouettes(euclid, x).mean() for x in (one, two)], abs=1e-6)


def test_best_k_scans_as_the_reference(spark, sf):
    assert sorted(r["k"] for r in QUERIES["best_k"](spark, sf).collect()) == list(range(35, 45))


def test_whole_texts_and_vectors(spark, tmp_path):
    texts = ["x" * 61 + "é☃", "", "😀 " * 200]
    v = vectors_of(4, dims=64, copies=1)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = {r["doc_id"]: r for r in QUERIES["base64_roundtrip"](spark, str(tmp_path)).collect()}
    assert all(rows[i]["decoded"] == t and rows[i]["encoded"] == base64.b64encode(t.encode()).decode() for i, t in enumerate(texts))
    units = {r["vec_id"]: r["unit"] for r in QUERIES["normalize_vectors"](spark, str(tmp_path)).collect()}
    assert all(units[i] == pytest.approx((x / np.linalg.norm(x)).tolist(), abs=2e-6) for i, x in enumerate(v.astype(float)))


def test_titles_and_unit_vectors_as_in_sql(spark, tmp_path):
    """A title cut inside a reference and one with a quote; components that round to zero from below, and a vector of zeros."""
    pages = [(1, "https://e.com/1", "<title>A&amp;&amp</title><body>x</body>"), (2, "https://e.com/2", "<title>t = &quot;7 &amp;quot; &lt;\"&#x27;</title><body><p>y</p></body>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    vectors = [(1, [-1e-8, 1.0, 1e-8, 0.0]), (2, [0.0, 0.0, 0.0, 0.0]), (3, [3.0, -4.0, 0.0, -0.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, table, of in (("article_extract", "pages", "page_id"), ("normalize_vectors", "embeddings", "vec_id")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        found = con.sql(load().oracles()[name])
        got = QUERIES[name](spark, str(tmp_path)).select(*found.columns).orderBy(of).collect()
        assert [repr(tuple(r)) for r in got] == [repr(r) for r in found.order(of).fetchall()]


@pytest.mark.parametrize("name", ["lemma_words", "article_clean", "index_segments", "learned_chunks", "content_signature", "anchor_metadata", "fuzzy_similar"])
def test_workers_hold_few_texts_at_once(spark, sf, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        assert QUERIES[name](spark, sf).columns
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)


def test_sums_of_silhouettes_leave_few_tasks(spark, monkeypatch):
    """A row's sums are sent once for each part of the right side, not once for each of its blocks."""
    v = vectors_of(1200)
    frame = spark.createDataFrame([(i, x.tolist(), [i % 4]) for i, x in enumerate(v)], "id long, u array<double>, labels array<int>").repartition(16)
    sides, seen = [], type(frame).crossJoin
    monkeypatch.setattr(type(frame), "crossJoin", lambda self, other: sides.append(other) or seen(self, other))
    d = np.linalg.norm(v[:, None] - v[None, :], axis=2)
    assert blocks.full_silhouettes(frame, "id", "u", "labels", [4], size=20) == pytest.approx([silhouettes(d, np.arange(1200) % 4).mean()], abs=1e-6)
    assert sides[0].rdd.getNumPartitions() <= blocks.SIDES


def test_silhouettes_count_rows_not_ids(spark):
    """Rows with one id, or none, are rows of their own; blocks are smaller than clusters, and larger."""
    v = vectors_of(300, copies=3).astype(float)
    labels = np.stack([np.arange(300) % 3, np.arange(300) // 5 % 7], axis=1)
    frame = spark.createDataFrame([(None if i % 3 else 1, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(v, labels, strict=True))], "id long, u array<double>, labels array<int>")
    d = np.linalg.norm(v[:, None] - v[None, :], axis=2)
    want = [silhouettes(d, labels[:, j]).mean() for j in (0, 1)]
    for size in (33, 1000):
        assert blocks.full_silhouettes(frame, "id", "u", "labels", [4, 7], size=size) == pytest.approx(want, abs=1e-6)


def test_fits_of_a_scan_run_side_by_side(spark, sf, monkeypatch):
    every, fit = threading.Barrier(10), clustering.KMeans.fit

    def waiting(self, *args):
        every.wait(60)
        return fit(self, *args)

    monkeypatch.setattr(clustering.KMeans, "fit", waiting)
    assert QUERIES["best_k"](spark, sf).count() == 10
