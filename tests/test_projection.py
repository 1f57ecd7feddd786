"""Sparse SVD against numpy, and the layout against an in-memory run of the same rule."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.operators import layout as L
from trawl.operators import lsa as A
from trawl.scratch import Scratch, materialise

# singular values


def dense(rows, terms):
    found = rows.orderBy(rows.columns[0]).collect()
    out = np.zeros((len(found), terms))
    for i, r in enumerate(found):
        out[i, r["cols"]] = r["vals"]
    return [r[0] for r in found], out


def test_singular_values_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows, terms = A.term_space(docs, "doc_id", "text")
    rows = materialise(rows, "terms")
    found = A.truncated_svd(rows, terms, 40, docs.count())
    ids, matrix = dense(rows, terms)
    assert np.allclose(np.linalg.norm(matrix, axis=1), 1.0)
    expected = np.linalg.svd(matrix, compute_uv=False)[:40]
    assert np.abs(found.values - expected).max() < 1e-6
    image = matrix @ found.components
    whole = np.vstack([matrix, np.zeros((docs.count() - len(ids), terms))])
    share = np.var(whole @ found.components, axis=0).sum() / np.var(whole, axis=0).sum()
    assert abs(found.explained - share) < 1e-9 and 0 < share < 1
    got = {r["doc_id"]: r["vector"] for r in A.projected(rows, "doc_id", found.components).collect()}
    assert np.abs(np.array([got[i] for i in ids]) - image).max() < 1e-9


@pytest.mark.parametrize("rank", [0, 1, 3])
def test_singular_values_of_low_rank(spark, rank, monkeypatch):
    monkeypatch.setattr(A, "PIECE", 7)
    monkeypatch.setattr(A, "FAN", 2)
    rng = np.random.default_rng(rank)
    matrix = rng.standard_normal((30, rank)) @ rng.standard_normal((rank, 12)) if rank else np.zeros((30, 12))
    table = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(matrix)]
    rows = spark.createDataFrame(table, "id long, cols array<int>, vals array<double>").repartition(5)
    found = A.truncated_svd(rows, 12, 5, 30)
    assert np.abs(found.values - np.linalg.svd(matrix, compute_uv=False)[:5]).max() < 1e-9
    nothing = A.truncated_svd(rows.limit(0), 12, 5, 0)
    assert not nothing.values.any() and nothing.explained == 0.0


# layout


def in_memory(positions, drawn, a, b, epochs):
    """The same rule with arrays; drawn has (tail, head, pushed) of each epoch."""
    y = positions.copy()
    for epoch, (tail, head, pushed) in enumerate(drawn):
        target, other = np.concatenate([head, pushed.ravel()]), np.concatenate([tail, np.repeat(tail, pushed.shape[1])])
        pull = np.arange(len(target)) < len(head)
        fine = target != other
        target, other, pull = target[fine], other[fine], pull[fine]
        way = y[target] - y[other]
        square = (way**2).sum(axis=1)
        bend = 1 + a * square**b
        with np.errstate(divide="ignore", invalid="ignore"):
            towards = np.where(square > 0, -2 * a * b * square ** (b - 1) / bend, 0.0)
        force = np.where(pull, towards, 2 * b / ((0.001 + square) * bend))
        moved = np.zeros_like(y)
        np.add.at(moved, target, np.clip(force[:, None] * way, -4, 4))
        pulls = np.bincount(target[pull], minlength=len(y))
        y = y + (1 - epoch / epochs) * moved / np.maximum(pulls, 1)[:, None]
    return y


def preserved(vectors, y, k=15):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    far = 1 - u @ u.T
    flat = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    for d in (far, flat):
        np.fill_diagonal(d, np.inf)
    return np.mean([len(set(p) & set(q)) / k for p, q in zip(np.argsort(far, 1)[:, :k], np.argsort(flat, 1)[:, :k], strict=True)])


def clustered(n, seed=5):
    """Small clusters in 12 dimensions, of which two components keep little apart."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n // 20, 12))[np.arange(n) % (n // 20)] + 0.15 * rng.standard_normal((n, 12))


def test_layout_equals_in_memory_run(spark):
    vectors, epochs = clustered(2000), 15
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(6, "id")
    a, b = L.curve()
    with Scratch(spark) as scratch:
        nodes = scratch.write(L.numbered_rows(rows.select("id", F.col("v").alias("vector")), scratch), "nodes")
        assert sorted(r["node"] for r in nodes.collect()) == list(range(2000))
        asked = nodes.select(F.col("node").alias("id"), F.col("vector").alias("embedding"))
        near = L.nearest_by_pivots(asked, asked, 15).filter("query_id <> id").select("query_id", "id", "distance")
        edges = scratch.write(L.fuzzy_graph(near, 15), "edges")
        e = edges.toPandas()
        assert len(e) == len(e[["tail", "head"]].drop_duplicates()) and e.weight.between(0, 1).all()
        # the union of memberships, each row's adding up to log2(15)
        own = {}
        lists = near.toPandas().sort_values("distance").groupby("query_id")
        for q, x in lists:
            m = L.memberships(x["distance"].to_numpy()[None], np.log2(15))[0]
            assert abs(m.sum() - np.log2(15)) < 1e-6
            own |= {(q, i): w for i, w in zip(x["id"], m, strict=True)}
        union = {p: own.get(p, 0) + own.get(p[::-1], 0) - own.get(p, 0) * own.get(p[::-1], 0) for p in zip(e["tail"], e["head"], strict=True)}
        assert np.allclose(e.weight, [union[p] for p in zip(e["tail"], e["head"], strict=True)])

        positions = scratch.write(L.started(nodes), "positions")
        start = positions.toPandas().set_index("node").sort_index()[["x", "y"]].to_numpy()
        drawn = []
        for epoch in range(epochs):
            d = L.drawn(edges, 2000, epoch, 5, 42).toPandas()
            drawn.append((d["tail"].to_numpy(), d["head"].to_numpy(), np.stack(d["pushed"].to_numpy())))
            positions = scratch.write(L.epoch_moves(positions, edges, 2000, epoch, epochs, a, b, 5, 42), "positions")
        got = positions.toPandas().set_index("node").sort_index()[["x", "y"]].to_numpy()
        expected = in_memory(start, drawn, a, b, epochs)
        order = nodes.toPandas().set_index("node").sort_index()["id"].to_numpy()
    assert np.abs(got - expected).max() < 1e-6
    kept = preserved(vectors[order], got)
    assert abs(kept - preserved(vectors[order], expected)) < 0.05 and kept > 2 * preserved(vectors[order], start)


def test_layout_of_copies_and_little(spark):
    rows = [(i, [1.0, 0.0, float(i % 7)]) for i in range(40)] + [(90, None), (91, [0.0, 0.0, 0.0])]
    got = {r["id"]: (r["x"], r["y"]) for r in L.layout(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", k=4, epochs=3).collect()}
    assert sorted(got) == list(range(40)) and len(set(got.values())) == 7 and got[0] == got[7]
    assert L.layout(spark.createDataFrame(rows[:1], "id long, v array<double>"), "id", "v").count() == 1
    assert L.layout(spark.createDataFrame([], "id long, v array<double>"), "id", "v").count() == 0


def test_curve_fits():
    for shape, known in (((0.1, 1.0), (1.577, 0.895)), ((0.5, 1.0), (0.583, 1.334))):
        assert np.abs(np.array(L.curve(*shape)) - known).max() < 0.01


def test_decomposition_takes_few_passes(spark, monkeypatch):
    """Singular values that fall slowly: all blocks together hold the space after six passes, and no cycle starts anew."""
    dense = np.random.default_rng(3).standard_normal((420, 300))
    rows = spark.createDataFrame([(list(range(300)), r.tolist()) for r in dense], "cols array<int>, vals array<double>")
    calls, times = [], A.gram_times
    monkeypatch.setattr(A, "gram_times", lambda *a: calls.append(1) or times(*a))
    found = A.truncated_svd(rows, 300, 40, 420)
    assert found.values == pytest.approx(np.linalg.svd(dense, compute_uv=False)[:40], rel=1e-6)
    assert len(calls) <= 7
