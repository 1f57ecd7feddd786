"""Pairs that share a rare shingle by chance: little is sent for them, and no link is lost by what tells them apart."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import near_dedup, ngram_join
from trawl.scratch import Scratch


def test_pairs_carry_no_prefixes(spark, make, monkeypatch):
    """120 texts of which each shares a rare passage with every other one, and a near copy of one."""
    rows = []
    for k in range(120):
        passages = [f"meet{min(k, m)}x{max(k, m)} at{min(k, m)} with{max(k, m)}" for m in range(120) if m != k and (k - m) % 7 == 0]
        rows.append((k, " ".join([*(f"w{k}x{i}" for i in range(200)), *passages])))
    rows.append((500, rows[3][1] + " end"))
    plans, write = [], Scratch.write

    def noted(self, df, name):
        plans.append((name, df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))))
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.joined(make(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {k: 3 if k == 500 else k for k, _ in rows}
    moved = [columns for _, plan in plans for columns in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)]
    assert not [columns for columns in moved if re.search(r"\b(rare_[uv]|second\w*|third\w*)#", columns)]
    assert [columns for columns in moved if re.search(r"\bbits_u#", columns)]


def test_bitmaps_lose_no_pair():
    rng = np.random.default_rng(5)
    for percent in (40, 80, 90):
        sets = [np.unique(near_dedup.mix64(rng.integers(0, 10**9, int(n)).astype(np.uint64))) for n in (1, 2, 63, 64, 65, 127, 129, 300, 1000)]
        for x in sets[:]:
            cut = int(rng.integers(0, max(1, len(x) // 8) + 1))
            sets.append(np.unique(np.concatenate([x[cut:], near_dedup.mix64(rng.integers(10**10, 10**11, 1 + len(x) // 16).astype(np.uint64))])))
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        bits = [np.frombuffer(b, np.uint64) for b in ngram_join.parities(np.concatenate(sets), bounds)]
        size = np.diff(bounds)
        assert all(min(size[k], ngram_join.MOST_BITS) <= 64 * len(b) <= max(2 * size[k], 64) for k, b in enumerate(bits))
        for step in (1, 1 << 20):
            allowed = ngram_join.differences_allowed(size[:, None], size[None, :], percent)
            fine = ngram_join.bits_allow(bits, bits, np.ones(allowed.shape, bool), allowed, step)
            for a, x in enumerate(sets):
                for b, y in enumerate(sets):
                    apart = ngram_join.bits_apart(bits[a], bits[b])
                    assert apart <= len(np.setxor1d(x, y))
                    assert fine[a, b] == (apart <= allowed[a, b])
    assert not fine[7, 8] and ngram_join.bits_apart(bits[7], bits[8]) > 60  # sets that have nothing in common


@pytest.mark.parametrize("percent", [80, 90])
def test_buckets_of_several_are_whole(spark, percent):
    rng = random.Random(percent)
    sizes = [1, 2, 10, 11, 50, 54, 60, 800, 40_000, 50_000]
    rows = [(0, rng.randrange(400), node, rng.choice(sizes)) for node in range(1200)]
    members = spark.createDataFrame(rows, "place int, shingle long, node long, size long")
    with Scratch(spark) as scratch:
        got = ngram_join.bucketed(members, percent, scratch).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes")).filter("size(nodes) > 1").collect()
    kinds = defaultdict(list)
    for _, shingle, node, size in rows:
        kind = int(np.floor(np.log(size) / np.log(100 / percent) * 0.999))
        kinds[shingle, kind].append(node)
        kinds[shingle, kind + 1].append(node)
    assert sorted(r["nodes"] for r in got) == sorted(sorted(nodes) for nodes in kinds.values() if len(nodes) > 1)
