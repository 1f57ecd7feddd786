"""Links between fuzzy hashes of large groups against comparing each pair alone."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from trawl.functions import fuzzy
from trawl.operators import likeness


def near_hashes(count, odd=()):
    """Hashes with parts of one signature, of two block sizes that follow each other, and some that are like none."""
    rng = np.random.default_rng(5)
    letters = np.array(list(fuzzy.ALPHABET))
    base = letters[rng.integers(0, 64, 64)]
    out = []
    for k in range(count):
        own = base.copy()
        own[rng.integers(0, 64, k % 4)] = letters[rng.integers(0, 64, k % 4)]
        half = "".join(own[: 32 - k % 9])
        whole = "".join(own[k % 5 :])
        out.append(f"3:{whole}:{half}" if k % 3 == 0 else f"6:{half}:{half[3:]}" if k % 3 == 1 else f"6:{whole}:{half}")
    return sorted({*out, *(f"12:{''.join(letters[rng.integers(0, 64, 40)])}:{''.join(letters[rng.integers(0, 64, 20)])}" for _ in range(5)), *odd})


def by_force(hashes):
    return {(x, y): n for x, y in itertools.combinations(range(len(hashes)), 2) if (n := fuzzy.hash_compare(hashes[x], hashes[y])) > 0}


@pytest.mark.parametrize("odd", [(), ("not a hash", "1:ABCDEFGHIJK:ABCDEFGHIJK", f"3:{'ABCDEFGH' * 12}:{'é' * 3}ABCDEFGH")])
def test_groups_give_each_pair_once(odd):
    hashes = near_hashes(120, odd)
    want, got = by_force(hashes), {}
    for key in sorted({g for h in hashes for g in likeness.grams(h)}):
        own = [k for k, h in enumerate(hashes) if key in likeness.grams(h)]
        every = np.arange(len(own))
        for p, q, n in zip(*(x.tolist() for x in likeness.compared(key, [hashes[k] for k in own], every, every, True)), strict=True):
            assert (own[p], own[q]) not in got
            got[own[p], own[q]] = n
    assert got == want and len(want) > 1000


def test_tasks_follow_the_pairs(spark, monkeypatch):
    """More pairs are dealt over more tasks, however few bytes they have, with the same links."""
    monkeypatch.setattr(likeness, "BLOCK", 16)
    monkeypatch.setattr(likeness, "SHARE", 200)
    tasks, compare = spark.sparkContext.accumulator(0), likeness._compare

    def noted(batches):
        tasks.add(1)
        yield from compare(batches)

    monkeypatch.setattr(likeness, "_compare", noted)
    hashes = near_hashes(90)
    rows = {r["id"]: (r["links"], r["other"], r["likeness"]) for r in likeness.links(spark.createDataFrame(list(enumerate(hashes)), "id long, h string")).collect()}
    want: dict[int, list] = {}
    for (x, y), n in by_force(hashes).items():
        want.setdefault(x, []).append((-n, y))
        want.setdefault(y, []).append((-n, x))
    assert rows == {k: (len(v), min(v)[1], -min(v)[0]) for k, v in want.items()}
    assert tasks.value > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
