"""Where operators look again at a part of the texts, the texts stay where they are read."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from trawl.llm import near_dedup, ngram_join
from trawl.llm.shared import made_of
from trawl.scratch import Scratch


def texts_of(count):
    """(doc_id, text) of texts of 60 words; every third differs from the one before by its last word."""
    return [(k, " ".join(f"w{k - (k % 3 == 2)}x{i}" for i in range(59)) + f" end{k}") for k in range(count)]


@pytest.mark.parametrize(("operator", "result"), [(near_dedup.near_classes, "class_id"), (ngram_join.joined, "component_id")])
def test_no_shuffle_of_texts(spark, make, monkeypatch, operator, result):
    """The sides that texts were joined with are too large for a broadcast here, as they are in large tables."""
    plans, write = [], Scratch.write

    def noted(self, df, name):
        plans.append(df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r[result] for r in operator(make(texts_of(90))).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {k: k - (k % 3 == 2) for k in range(90)}
    moved = [columns for plan in plans for columns in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)]
    assert moved
    assert not [columns for columns in moved if re.search(r"\btext#", columns)]


def test_made_of_wanted_rows(spark, make):
    """Rows that the bitmap lets pass by chance, rows without an id and rows of one id with several texts."""
    rows = [*texts_of(3000), (None, "a text without an id"), (7, "another text of row 7")]
    texts = make(rows).select("doc_id", F.xxhash64("text").alias("mark"), "text")

    def work(batches):
        yield from (b.select(["doc_id", "mark", "text"]) for b in batches)

    with Scratch(spark) as scratch:
        wanted = texts.filter("doc_id IS NULL OR doc_id % 5 = 0 OR text LIKE 'another%'").select(F.xxhash64("text").alias("node"), "doc_id", "mark")
        got = made_of(texts, scratch.write(wanted, "wanted"), work, "text string").select("text", (F.xxhash64("text") == F.col("node")).alias("own")).collect()
    assert sorted((r["text"], r["own"]) for r in got) == sorted((t, True) for i, t in rows if i is None or i % 5 == 0 or t.startswith("another"))
