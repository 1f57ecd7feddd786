"""Neighbours by pivots against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from trawl.operators import blocks as K
from trawl.operators import pivots as P


def pairs(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in df.collect())


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<double>").repartition(5)


@pytest.mark.parametrize("size", [16, 2048])
def test_equal_to_all_pairs_with_fewer_comparisons(spark, size):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((60, 16))[np.arange(3000) % 60] + 0.05 * rng.standard_normal((3000, 16))
    vectors[100:140] = vectors[100]  # copies tie
    vectors[500:520] = 3 * vectors[100]
    rows, told = table(spark, vectors), []
    asked = rows.filter("id % 20 = 0")
    got = P.nearest_by_pivots(asked, rows, 10, size=size, tell=told.append)
    assert pairs(got) == pairs(K.nearest_for_all(asked, rows, 10))
    assert told[0] < asked.count() * 3000 / 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("at_once", [1, 1 << 20])
def test_few_queries_equal_to_all_pairs_and_write_no_vectors(spark, monkeypatch, at_once):
    monkeypatch.setattr(P, "AT_ONCE", at_once)
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((700, 8))
    vectors[100:160] = 2 * vectors[100]
    vectors[[3, 40]] = 0
    rows, asked = table(spark, vectors), table(spark, vectors).filter("id % 20 = 0")
    for n in (7, 900):
        assert pairs(P.nearest_of_few(asked, rows, n)) == pairs(K.nearest_for_all(asked, rows.filter("id NOT IN (3, 40)"), n).filter("query_id <> 40"))
    assert P.nearest_of_few(asked, rows.limit(0), 3).count() == 0 == P.nearest_of_few(asked.limit(0), rows, 3).count()
    monkeypatch.setattr(P, "FEW_QUERIES", 10)
    assert P.nearest_of_few(asked, rows, 7) is None


def test_few_rows_and_vectors_without_length(spark):
    rows = table(spark, [[1, 0], [0, 1], [1, 1], [0, 0], None])
    got = pairs(P.nearest_by_pivots(rows, rows, 10))
    assert [x[:3] for x in got] == [(0, 1, 0), (0, 2, 2), (0, 3, 1), (1, 1, 1), (1, 2, 2), (1, 3, 0), (2, 1, 2), (2, 2, 0), (2, 3, 1)]
    assert P.nearest_by_pivots(rows, rows.limit(0), 3).count() == 0 == P.nearest_by_pivots(rows.limit(0), rows, 3).count()


def test_vectors_without_clusters_are_not_sent_to_each_open_cell(spark, monkeypatch):
    """Every cell is open to every query here, so what is written must not go with the cells."""
    rows = table(spark, np.random.default_rng(10).standard_normal((1200, 24)))
    written, write = {}, P.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(P.Scratch, "write", counted)
    got = P.nearest_by_pivots(rows, rows, 5, size=256)
    assert written["visits"] < 5 * 1200
    assert pairs(got) == pairs(K.nearest_for_all(rows, rows, 5))
