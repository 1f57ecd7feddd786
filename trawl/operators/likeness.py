"""Links between fuzzy hashes: how many others each is alike to, and which most.

Two hashes can only be alike if signatures of one block size have a 7-gram in common. Hashes therefore meet by block size and
gram, and grams that the same hashes have are one: the first of them is kept. Only numbers are sent to find these, the
hashes themselves go to the grams that are left. A gram that very many have is cut into blocks that meet in pairs. A pair is compared at the first of its common grams
alone, and inside a task, so that pairs never become rows: what leaves a task is a count and a best partner a hash.

The pairs of a group of near copies grow with its square, as a count of all links demands. They are compared in numpy, some ten
thousands at once, and dealt over as many tasks as their number asks for, so that a task's share of them doesn't grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions import fuzzy
from trawl.scratch import Scratch, materialise

#: Hashes of a gram that are compared with as many others at once.
BLOCK = 1024
#: Groups up to this size are looked at pair by pair without a table of grams, and so many pairs are compared one by one.
FEW = FEW_PAIRS = 32
#: Pairs of a task, about, and tasks, at most.
SHARE, MOST_TASKS = 1 << 22, 20_000
#: Grams of a table that says which hashes have them.
WIDTH = 2048


_LETTERS = frozenset(fuzzy.ALPHABET)
_ODD = 0x9E3779B97F4A7C15


def _numbers(size: int, signature: str) -> frozenset[int]:
    """A number for each 7-gram of a signature of a block size; those of ASCII never coincide within a block size."""
    n = len(signature) - fuzzy.WINDOW + 1
    if n <= 0:
        return frozenset()
    codes, out = np.frombuffer(signature.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(fuzzy.WINDOW):
        out = (out << np.uint64(7)) + codes[k : k + n]
    return frozenset((out * np.uint64(_ODD) ^ np.uint64(size * _ODD * _ODD % (1 << 64))).view(np.int64).tolist())


@lru_cache(maxsize=4096)
def parted(h: str) -> tuple[int, tuple[str, str], tuple[frozenset[int], frozenset[int]], bool] | None:
    """Block size, both signatures, shortened, a number for each 7-gram of these and their block sizes, and whether h is as
    `fuzzy_hash` writes it, so that its signatures fit words; None for what is no hash."""
    try:
        block, one, two = h.split(":", 2)
        size = int(block)
    except ValueError:
        return None
    short = fuzzy._shorten(one), fuzzy._shorten(two)
    plain = fuzzy.SMALLEST <= size < 1 << 40 and all(len(x) <= fuzzy.LENGTH and _LETTERS.issuperset(x) for x in short)
    return size, short, (_numbers(size, short[0]), _numbers(2 * size, short[1])), plain


def grams(h: str) -> frozenset[int]:
    """A number for each block size and 7-gram of the hash's two signatures; empty for what is no hash."""
    found = parted(h)
    return found[2][0] | found[2][1] if found else frozenset()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h) -> (key, id) for each gram of h."""
    for batch in batches:
        found = [grams(h) for h in batch.column(1).to_pylist()]
        own = pa.array(np.repeat(np.arange(len(found)), [len(g) for g in found]))
        yield pa.RecordBatch.from_arrays([pa.array([k for g in found for k in g], pa.int64()), batch.column(0).take(own)], ["key", "id"])


def with_common(sets: list[list[int]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A matrix that says of each of left and each of right whether their sets have a number in common."""
    values, place, times = np.unique(np.array([g for m in sets for g in m], np.int64), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(m) for m in sets])
    # a number that one set alone has tells nothing
    common = times > 1
    row, place = row[common[place]], (np.cumsum(common) - 1)[place[common[place]]]
    out = np.zeros((len(left), len(right)), bool)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for k in range(0, int(common.sum()), WIDTH):
        a, b = np.searchsorted(place, (k, k + WIDTH))
        table = np.zeros((len(sets), min(WIDTH, int(common.sum()) - k)), np.float32)
        table[row[a:b], place[a:b] - k] = 1
        out |= table[left] @ table[right].T > 0
    return out


def compared(key: int, hashes: list[str], left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, likeness) of the pairs of left and right (if these are the same, each once) that are alike and have no common gram
    before key, which all hashes have."""
    parts = [parted(h) for h in hashes]
    plain = all(part and part[3] for part in parts)
    if len(left) * len(right) <= FEW * FEW or not plain:
        own = [grams(h) for h in hashes]
        met = [(x, y) for x in left.tolist() for y in right.tolist() if (not same or x < y) and min(own[x] & own[y]) == key]
        p, q = (np.array([m[c] for m in met], np.int64) for c in (0, 1))
    else:
        alone = ~with_common([[g for m in part[2] for g in m if g < key] for part in parts], left, right)
        if same:
            alone &= left[:, None] < right[None, :]
        x, y = np.nonzero(alone)
        p, q = left[x], right[y]
    if len(p) <= FEW_PAIRS or not plain:
        out = np.array([fuzzy.hash_compare(hashes[x], hashes[y]) for x, y in zip(p.tolist(), q.tolist(), strict=True)], np.int64)
        return p[out > 0], q[out > 0], out[out > 0]
    # the key is of one block size, that of a hash's first signature or of its second; the other one counts where both have the
    # same block size
    second = np.array([key not in part[2][0] for part in parts])
    size = parts[0][0] << int(second[0])
    out = fuzzy.scores(*fuzzy.encoded([part[1][int(k)] for part, k in zip(parts, second, strict=True)]), p, q, size)
    beside = with_common([list(part[2][int(not k)]) for part, k in zip(parts, second, strict=True)], np.arange(len(parts)), np.arange(len(parts)))[p, q]
    codes = fuzzy.encoded([part[1][int(not k)] for part, k in zip(parts, second, strict=True)])
    for kind, block in ((False, 2 * size), (True, size // 2)):
        more = np.flatnonzero(beside & (second[p] == kind) & (second[q] == kind))
        if len(more):
            out[more] = np.maximum(out[more], fuzzy.scores(*codes, p[more], q[more], block))
    fine = out > 0
    return p[fine], q[fine], out[fine]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, sub, id, h) sorted by key, i and j -> (id, links, other, likeness): of each id the pairs of these rows."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
    told: dict[int, list[int]] = {}

    def work(rows: list[tuple]) -> None:
        key, i, j = rows[0][:3]
        rows.sort(key=lambda r: r[4])  # by id, so that of equally alike hashes the first place counts
        sub, n = np.array([r[3] for r in rows]), len(rows)
        p, q, likeness = compared(key, [r[5] for r in rows], np.flatnonzero(sub == i), np.flatnonzero(sub == j), i == j)
        own, others = np.concatenate([p, q]), np.concatenate([q, p])
        best, count = np.zeros(n, np.int64), np.bincount(own, minlength=n)
        np.maximum.at(best, own, np.tile(likeness, 2) * n + (n - 1 - others))
        for k in np.flatnonzero(count).tolist():
            value, place = divmod(int(best[k]), n)
            other = rows[n - 1 - place][4]
            now = told.setdefault(rows[k][4], [0, other, value])
            now[0] += int(count[k])
            if (-value, other) < (-now[2], now[1]):
                now[1:] = other, value

    def out() -> pa.RecordBatch:
        rows = [(a, *v) for a, v in told.items()]
        told.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["id", "links", "other", "likeness"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                work(held)
                held = []
            held.append(row)
        if len(told) > 50_000:
            yield out()
    if held:
        work(held)
    yield out()


def links(hashes: DataFrame) -> DataFrame:
    """(id, links, other, likeness) of the rows of hashes (id, h; both distinct) that are alike to any other: how many, and the
    one with the highest likeness, the smaller id on ties."""
    with Scratch(hashes.sparkSession) as scratch:
        rows = scratch.write(hashes.select("id", "h").mapInArrow(_keys, "key long, id long"), "grams")
        members = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
        common = rows.groupBy("key").agg(F.count("*").alias("n"), *members).filter("n > 1")
        # the least of the grams with the same members is the first common one of all pairs that have any of them
        common = common.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        common = scratch.write(common, "common")
        pairs = common.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        tasks = min(MOST_TASKS, max(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / SHARE) + 1))
        met = scratch.write(rows.join(common.select("key", "blocks").hint("merge"), "key"), "members")
        dealt = met.join(hashes.select("id", "h").hint("merge"), "id").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        paired = dealt.select("key", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", "id", "h")
        paired = paired.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        found = paired.mapInArrow(_compare, "id long, links long, other long, likeness int")
        best = F.min(F.struct((-F.col("likeness")).alias("less"), "other"))
        return materialise(found.groupBy("id").agg(F.sum("links").alias("links"), best.alias("best")).select("id", "links", "best.other", (-F.col("best.less")).alias("likeness")), "links")
