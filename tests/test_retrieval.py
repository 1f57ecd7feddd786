"""The chain from pages to ranked and graded segments against loops over everything, and the index with few probes."""

from __future__ import annotations

import math

import numpy as np
import pytest

from trawl.operators import blocks as K
from trawl.operators import models as M
from trawl.operators import segment_index as SI
from trawl.plans import retrieval_queries as R


@pytest.fixture(scope="module")
def ranked(spark, sf):
    """query_id -> [(id, page_id, segment, rank by distance, cross score)] in the order of the scores, by loops."""
    rows = R.segments(spark, sf).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    own = np.array([r["embedding"] for r in rows], float)
    norm = np.linalg.norm(own, axis=1)
    out = {}
    for q in R.questions(spark, sf).collect():
        asked = np.array(q["embedding"], float)
        far = np.round(1 - own @ asked / np.where(norm > 0, norm, np.nan) / np.linalg.norm(asked), 12)
        order = [k for k in np.lexsort((np.array([r["id"] for r in rows]), far)) if norm[k] > 0][:100]
        cross = M.OverlapReranker().score(q["query"], [rows[k]["page_segment"] for k in order])
        best = sorted(range(len(order)), key=lambda i: (-cross[i], i))
        out[q["id"]] = q["query"], [(rows[order[i]]["id"], rows[order[i]]["page_id"], rows[order[i]]["page_segment"], i + 1, cross[i]) for i in best]
    return out


def test_retrieval_equals_loops(spark, sf, ranked):
    got = {}
    for r in R.retrieve(spark, sf).orderBy("query_id", "new_rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["page_id"], r["page_segment"], r["rank"], pytest.approx(r["cross"])))
    assert got == {q: rows[:10] for q, (_, rows) in ranked.items()}


def test_grades_equal_loops(spark, sf, ranked):
    got = {r["query_id"]: r["ndcg"] for r in R.graded_retrieval(spark, sf).collect()}
    for q, (query, rows) in ranked.items():
        rows = rows[:10]
        gains = [2.0**g - 1 for g in M.OverlapGrader().grade(query, [x[2] for x in rows])]
        tied = [np.mean([g for g, y in zip(gains, rows, strict=True) if y[4] == x[4]]) for x in rows]
        dcg, ideal = (sum(g / math.log2(i + 2) for i, g in enumerate(own)) for own in (tied, sorted(gains, reverse=True)))
        assert got[q] == pytest.approx(dcg / ideal if ideal else 0.0)
    assert got.keys() == ranked.keys()


def test_index_recall_where_probes_are_few(spark, tmp_path, monkeypatch):
    """200 cells, of which a query looks into 12."""
    monkeypatch.setattr(SI, "CELL_ROWS", 20)
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((80, 24))[np.arange(4000) % 80] + 0.35 * rng.standard_normal((4000, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    SI.create(rows, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i" / "centres")).count() == 200 > 10 * SI.PROBES
    asked = rows.filter("id % 20 = 0")
    found = {(r["query_id"], r["id"]) for r in SI.search(spark, str(tmp_path / "i"), asked, 10).collect()}
    exact = {(r["query_id"], r["id"]) for r in K.nearest_for_all(asked, rows, 10).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
