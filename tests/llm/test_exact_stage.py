"""The pipeline's exact dedup keeps one row of each group, whatever the ids."""

from __future__ import annotations

from trawl.llm import exact_dedup


def test_stage_keeps_one_row_of_each_group(spark, make):
    rows = [(1, "a b"), (None, "a  b"), (None, "x"), (None, "x"), (5, "s"), (5, "s"), (6, "t"), (6, "a b"), (7, "t"), (8, None), (9, "")]
    got = exact_dedup.stage(spark, make(rows), "")
    assert got.columns == make(rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, "a b"), (None, "x"), (5, "s"), (6, "t"), (8, None)], key=repr)
    assert [r["doc_id"] for r in exact_dedup.stage(spark, make([(1, "a"), (2, "a"), (3, "b")]), "").orderBy("doc_id").collect()] == [1, 3]
    assert exact_dedup.stage(spark, make([]), "").count() == 0
