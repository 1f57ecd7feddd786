"""Operator 11, Jaccard join of shingle sets by filters under several global orders.

A document's set is its distinct shingles of three words (ASCII lower case). Sets of sizes a and b with a similarity of t
share at least t max(a, b) elements, so under any order of all shingles the n - ceil(t n) + 1 first elements of both, their
prefixes, have one in common. Three orders are used: rare first (by the counts of a sketch of SLOTS counters over the
whole corpus, whose errors cost time but no link), and two by hashes. Moreover, of two prefixes of one order all elements
up to the lesser end are known for both, and those that only one of them has count against the pair: a pair is a candidate
only if it meets in a prefix of the first order and no order shows more differing elements than a link allows. Candidates
are verified by their whole sets.

Equal sets are one node. A bucket holds the nodes that have a shingle in their prefixes under the first order and whose
sizes are of one class or the one below; buckets with the same members are one. The members are paired with one hub, the
same for all buckets that hold it, so that groups are linked by stars. Buckets that then still hold several components are
searched for links that no hub saw: the members outside the bucket's largest component meet all others block by block
inside tasks, which return only links of different components, verified there. A pair is looked at in the bucket of its first
common shingle alone, where the elements that either has before it differ; the hub is the member with the fewest of them, as
of near copies the one with the fewest edits of its own links most.

Most pairs that meet in a prefix share a rare shingle by chance, and the larger the corpus the more of them. They are told apart
by bitmaps: an element that only one of two sets has changes one parity, so a pair whose bitmaps differ in more bits than a
link allows is none. A bitmap is about a fortieth of a set, so little is sent of the nodes whatever the pairs. Whole sets are sent
for what the bitmaps leave, and the prefixes under all orders are made of these where they have arrived.

Shingles are known by 64-bit hashes. Defined cases: a text of fewer words than a shingle has is one shingle; a text without
words (null too) has an empty set, links with nothing and is its own component; rows whose id is null are linked as all
others, and their component is null where it has no id at all; rows that repeat an id are told apart by their texts; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import near_dedup
from trawl.llm.components import components
from trawl.llm.near_dedup import block_pairs, compare, shingles, similarity
from trawl.llm.shared import bounded_batches, documents, made_of, marked_rows, mix64, salted_join, slices, trimmed
from trawl.scratch import Scratch, materialise

WORDS, PERCENT = 3, 90
#: Counters of the sketch: at most this many rows reach the driver.
SLOTS = 1 << 18
ORDERS = ("rare", "second", "third")
#: Bits of a bitmap, within which they follow the size of the set.
LEAST_BITS, MOST_BITS = 1 << 6, 1 << 17
_SEEDS = tuple(np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(elements, bounds): the sorted distinct shingles of each text."""
    shingle, owner, _ = shingles(data, offsets, words)
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=len(offsets) - 1))]).astype(np.int64)


def slot_of(elements: np.ndarray) -> np.ndarray:
    return (elements % np.uint64(SLOTS)).astype(np.int64)


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """Elements of a set of n that a linked set must have one of, under any order; none of an empty set."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def differences_allowed(a, b, percent: int):
    """Elements that only one of two linked sets of sizes a and b has, at most."""
    return (100 - percent) * (a + b) // (100 + percent)


def _counted(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(SLOTS, np.int64)
        with trimmed():
            for batch in batches:
                for _, _, data, offsets in slices(batch.column(0)):
                    hits += np.bincount(slot_of(sets(data, offsets, words)[0]), minlength=SLOTS)
            at = np.flatnonzero(hits)
            for k in range(0, len(at), 1 << 16):
                own = at[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(hits[own])], ["slot", "hits"])

    return work


def rarity(texts: DataFrame, words: int) -> np.ndarray:
    """A byte for each slot of the sketch, which rises with the number of sets that hold a shingle of the slot."""
    hits = texts.select("text").mapInArrow(_counted(words), "slot int, hits long").groupBy("slot").agg(F.sum("hits").alias("hits"))
    found = hits.select("slot", F.least(F.floor(4 * F.log2(F.col("hits"))), F.lit(255)).cast("short").alias("level")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[found["slot"].to_numpy()] = found["level"].to_numpy().astype(np.uint8)
    return out


def ranks(elements: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """The place of each element under each order, as a number that tells it from others."""
    first = (levels[slot_of(elements)].astype(np.uint64) << np.uint64(56)) | (elements >> np.uint64(8))
    return [first, *(mix64(elements ^ seed) for seed in _SEEDS)]


def prefixed(elements: np.ndarray, bounds: np.ndarray, levels: np.ndarray, percent: int, orders: int = len(ORDERS)) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bounds, a list for each of the first orders): the prefixes of sets, each ascending."""
    n = np.diff(bounds)
    owner, p = np.repeat(np.arange(len(n)), n), prefix_sizes(n, percent)
    out = []
    for rank in ranks(elements, levels)[:orders]:
        order = np.lexsort((rank, owner))
        out.append(rank[order][np.arange(len(order)) - bounds[owner] < p[owner]])
    return np.concatenate([[0], np.cumsum(p)]), out


def parities(elements: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A bitmap for each set: the parities of the numbers of its elements with a hash in each of its places, which are a power
    of two and as many as elements, within bounds. An element that only one of two sets has changes one bit."""
    n = np.diff(bounds)
    bits = np.int64(1) << np.ceil(np.log2(np.clip(n, LEAST_BITS, MOST_BITS))).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(bits)])
    place = (elements >> np.uint64(20)).astype(np.int64) & np.repeat(bits - 1, n)
    odd = np.bincount(np.repeat(starts[:-1], n) + place, minlength=starts[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip(starts[:-1] >> 3, starts[1:] >> 3, strict=True)]


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ: at most as many as elements that only one of the two sets has."""
    words = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, words)) ^ np.bitwise_xor.reduce(y.reshape(-1, words))).sum())


def bits_allow(x: list[np.ndarray], y: list[np.ndarray], fine: np.ndarray, allowed: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """The matrix fine (of x by y) without the pairs whose bitmaps differ in more bits than allowed."""
    out, wide, high = np.zeros_like(fine), np.array([len(b) for b in x]), np.array([len(b) for b in y])
    for a in np.unique(wide):
        for b in np.unique(high):
            rows, columns, words = np.flatnonzero(wide == a), np.flatnonzero(high == b), min(a, b)
            if not fine[np.ix_(rows, columns)].any():
                continue
            left, right = (np.bitwise_xor.reduce(np.stack([z[k] for k in own]).reshape(len(own), -1, words), axis=1) for z, own in ((x, rows), (y, columns)))
            most = max(1, step // right.size)
            for k in range(0, len(rows), most):
                at = np.ix_(rows[k : k + most], columns)
                differ = np.bitwise_count(left[k : k + most, None, :] ^ right[None, :, :]).sum(axis=2, dtype=np.int64)
                out[at] = fine[at] & (differ <= allowed[at])
    return out


def _prefixed(levels, words: int, percent: int):
    """The first two columns, text -> the same columns, the digest of the set, its size, its prefix under the first order and its
    bitmap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        with trimmed():
            for batch in batches:
                for at, to, data, offsets in slices(batch.column(2)):
                    elements, bounds = sets(data, offsets, words)
                    n = np.diff(bounds)
                    digests = np.zeros((to - at, 2), np.uint64)
                    for j in range(2):
                        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(elements * np.uint64(2 * j + 1) + np.uint64(j + 1)), dtype=np.uint64)])
                        digests[:, j] = mix64(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64))
                    ends, (rare,) = prefixed(elements, bounds, level, percent, 1)
                    rare = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rare.view(np.int64)))
                    digest, bits = pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(parities(elements, bounds), pa.binary())
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[:2]), digest, pa.array(n), rare, bits], [*batch.schema.names[:2], "digest", "size", ORDERS[0], "bits"])

    return work


def _set_rows(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with trimmed():
            for batch in batches:
                for at, to, data, offsets in slices(batch.column(2)):
                    elements, bounds = sets(data, offsets, words)
                    own = [elements[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[:2]), pa.array(own, pa.binary())], [*batch.schema.names[:2], "cells"])

    return work


def _lists(column) -> list[np.ndarray]:
    """The rows of an Arrow column of long lists, as unsigned numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = np.asarray(column.values, np.int64).view(np.uint64), np.asarray(column.offsets)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Elements up to the lesser end of two prefixes of one order that only one of them has."""
    end = min(x[-1], y[-1])
    both = np.concatenate([x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]])
    both.sort()
    return len(both) - 2 * int((both[1:] == both[:-1]).sum())


def _words(column) -> list[np.ndarray]:
    """The rows of an Arrow column of binaries, as unsigned numbers."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _likely(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
            a, b = np.asarray(columns["size_u"]), np.asarray(columns["size_v"])
            fine = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
            allowed = differences_allowed(a, b, percent)
            xs, ys = _words(columns["bits_u"]), _words(columns["bits_v"])
            for k in np.flatnonzero(fine):
                fine[k] = bits_apart(xs[k], ys[k]) <= allowed[k]
            mask = pa.array(fine)
            yield pa.RecordBatch.from_arrays([columns["u"].filter(mask), columns["v"].filter(mask)], ["u", "v"])

    return work


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of a written table that sizes and bitmaps do not tell apart; a hub may be in many pairs."""
    facts = ("size", "bits")
    side = lambda at: nodes.select(F.col("node").alias(at), *[F.col(c).alias(f"{c}_{at}") for c in facts])
    half = salted_join(pairs, side("u"), "u")
    return salted_join(half, side("v"), "v", counts=pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"))).mapInArrow(_likely(percent), "u long, v long")


def _orders_of(cells: list[np.ndarray], levels: np.ndarray, percent: int) -> list[list[np.ndarray]]:
    """For each order the prefixes of these whole sets."""
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int64)
    ends, lists = prefixed(np.concatenate(cells), bounds, levels, percent)
    return [[flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] for flat in lists]


def _linked(levels, percent: int, rows: int = 64):
    """(u, v, cu, cv) -> (u, v) of the linked: pairs that no order tells apart and whose whole sets are near enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        with trimmed():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    xs, ys = _words(part.column(2)), _words(part.column(3))
                    allowed = [differences_allowed(len(x), len(y), percent) for x, y in zip(xs, ys, strict=True)]
                    both = list(zip(_orders_of(xs, level, percent), _orders_of(ys, level, percent), strict=True))
                    fine = [all(differing(x[k], y[k]) <= allowed[k] for x, y in both) and similarity(xs[k], ys[k]) >= percent / 100 for k in range(part.num_rows)]
                    mask = pa.array(fine, pa.bool_())
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["u", "v"])

    return work


def _common(xs: list[np.ndarray], ys: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """Numbers of elements that each of xs has in common with each of ys."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    flat, rows = (np.concatenate(xs), np.concatenate(ys)), (np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.repeat(np.arange(len(ys)), [len(y) for y in ys]))
    shared = np.intersect1d(*flat)
    for k in range(0, len(shared), step):
        part, sides = shared[k : k + step], []
        for values, row, n in zip(flat, rows, out.shape, strict=True):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            held, side = part[at] == values, np.zeros((n, len(part)), np.float32)
            side[row[held], at[held]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def block_candidates(size: np.ndarray, prefixes: list[list[np.ndarray]], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """A matrix that says of each of left and each of right whether sizes and all orders let them be linked."""
    a, b = size[left][:, None], size[right][None, :]
    fine = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    allowed = differences_allowed(a, b, percent)
    for lists in prefixes:
        if not fine.any():
            break
        xs, ys = [lists[k] for k in left], [lists[k] for k in right]
        end = np.minimum.outer(np.array([x[-1] for x in xs]), np.array([y[-1] for y in ys]))
        known = np.stack([np.searchsorted(x, e, "right") for x, e in zip(xs, end, strict=True)]) + np.stack([np.searchsorted(y, e, "right") for y, e in zip(ys, end.T, strict=True)]).T
        fine &= known - 2 * _common(xs, ys) <= allowed
    return fine


def _near_between(group: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, fine): the rows of a block pair, and a matrix that says of which the parts differ while sizes, places of the
    bucket's shingle and, where there are some, bitmaps let them be linked."""
    i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
    sub, part, size, place = (np.asarray(group.column(c)) for c in ("sub", "part", "size", "place"))
    left, right = np.flatnonzero(sub == i), np.flatnonzero(sub == j)
    fine = part[left][:, None] != part[right][None, :]
    if i == j:
        fine &= left[:, None] < right[None, :]
    a, b = size[left][:, None], size[right][None, :]
    fine &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    allowed = differences_allowed(a, b, percent)
    # in the bucket of the first common shingle all that is before it differs
    fine &= place[left][:, None] + place[right][None, :] <= allowed
    at = group.schema.get_field_index("bits")
    if at >= 0 and fine.any():
        bits = _words(group.column(at))
        rows, columns = np.flatnonzero(fine.any(axis=1)), np.flatnonzero(fine.any(axis=0))
        left, right, fine, allowed = left[rows], right[columns], fine[np.ix_(rows, columns)], allowed[np.ix_(rows, columns)]
        fine = bits_allow([bits[k] for k in left], [bits[k] for k in right], fine, allowed)
    return left, right, fine


def _candidates_between(group: pa.RecordBatch, percent: int, prefixes: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of candidates of different parts, by the prefixes under the first orders, within a block pair whose first common
    shingle is the bucket's."""
    none = np.zeros(0, np.int64)
    left, right, fine = _near_between(group, percent)
    if not fine.any():
        return none, none
    size, rare = np.asarray(group.column("size")), prefixes[0]
    shingle = np.asarray(group.column("shingle"), np.int64)[:1].view(np.uint64)[0]
    ahead = [x[: np.searchsorted(x, shingle)] for x in rare]
    fine &= _common([ahead[k] for k in left], [ahead[k] for k in right]) == 0
    # rows and columns without a pair need no look at their prefixes
    rows, columns = np.flatnonzero(fine.any(axis=1)), np.flatnonzero(fine.any(axis=0))
    if not len(rows):
        return none, none
    left, right, fine = left[rows], right[columns], fine[np.ix_(rows, columns)]
    if fine.sum() * 8 > fine.size:
        x, y = np.nonzero(fine & block_candidates(size, prefixes, left, right, percent))
    else:
        x, y = np.nonzero(fine)
        allowed = differences_allowed(size[left[x]], size[right[y]], percent)
        kept = np.array([all(differing(lists[m], lists[n]) <= d for lists in prefixes) for m, n, d in zip(left[x], right[y], allowed, strict=True)], bool)
        x, y = x[kept], y[kept]
    return left[x], right[y]


def _links_between(group: pa.RecordBatch, percent: int, levels: np.ndarray) -> tuple[list[int], list[int]]:
    """A link for each two parts that are linked within one block pair, verified by whole sets."""
    us, vs, known = [], [], set()
    part, member = np.asarray(group.column("part")), np.asarray(group.column("member"))
    if not _near_between(group, percent)[2].any():
        return us, vs
    cells = _words(group.column("cells"))
    for m, n in zip(*_candidates_between(group, percent, _orders_of(cells, levels, percent)), strict=True):
        between = (min(part[m], part[n]), max(part[m], part[n]))
        if between not in known and similarity(cells[m], cells[n]) >= percent / 100:
            known.add(between)
            us.append(min(member[m], member[n]))
            vs.append(max(member[m], member[n]))
    return us, vs


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of each key out of batches that are sorted by keys, which are integers."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([np.asarray(batch.column(k), np.int64) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(own[a])
            if held and key != last:
                yield whole()
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def in_block_pairs(labelled: DataFrame, counts: DataFrame, known: DataFrame, work, columns: str) -> DataFrame:
    """What work makes of each block pair of the buckets that hold several parts; labelled is a written table (bucket,
    shingle, node, place, part) without hubs, known has facts by node."""
    keys = ("bucket", "i", "j")
    keyed = block_pairs(labelled, counts, known.withColumn("member", F.col("node")), 2 * near_dedup.BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in columns.split(", ")]
        with trimmed():
            for group in _groups(batches, keys):
                made = work(group)
                if len(made[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names)

    return keyed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, columns).distinct()


def links_left(labelled: DataFrame, counts: DataFrame, nodes: DataFrame, percent: int, sets_of, levels, scratch: Scratch) -> DataFrame:
    """(u, v), written: links between different parts of a bucket. Pairs stay inside tasks, and what is sent grows as fewer
    members are left: bitmaps first; for the members of a bucket that are in a pair which these let pass, prefixes under the first
    order; for those in a pair that still passes in the bucket of its first common shingle, the whole sets that sets_of gives. Of
    these the prefixes under all orders are made inside the task, and what passes is verified."""

    def members(group: pa.RecordBatch, rows: np.ndarray) -> tuple[list[int], np.ndarray]:
        return [group.column("bucket")[0].as_py()] * len(rows), np.asarray(group.column("member"))[rows]

    def near(group: pa.RecordBatch) -> tuple[list[int], np.ndarray]:
        left, right, fine = _near_between(group, percent)
        return members(group, np.unique(np.concatenate([left[fine.any(axis=1)], right[fine.any(axis=0)]])))

    def named(group: pa.RecordBatch) -> tuple[list[int], np.ndarray]:
        return members(group, np.unique(np.concatenate(_candidates_between(group, percent, [_lists(group.column(ORDERS[0]))]))))

    def linked(group: pa.RecordBatch) -> tuple[list[int], list[int]]:
        return _links_between(group, percent, np.frombuffer(levels.value, np.uint8))

    def left_by(work, of: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        wanted = scratch.write(in_block_pairs(of, counts, known, work, "bucket long, node long"), "candidates")
        return wanted, scratch.write(of.join(wanted.hint("merge"), ["bucket", "node"], "left_semi"), "labelled")

    wanted, few = left_by(near, labelled, nodes.select("node", "size", "bits"))
    marked = nodes.select("node", "size", "bits", ORDERS[0], F.xxhash64("node").alias("mark"))
    wanted, few = left_by(named, few, marked_rows(marked, wanted.select(F.xxhash64("node").alias("mark")), "mark").drop("mark"))
    full = sets_of(wanted.select("node")).select("node", F.floor(F.length("cells") / 8).alias("size"), "cells")
    return scratch.write(in_block_pairs(few, counts, full, linked, "u long, v long"), "links")


def bucketed(members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """members (place, shingle, node, size) with the bucket of their shingle and class of size and that of the next class, since
    sizes of linked sets lie in one class or in two that follow each other; most rows that would be alone in a bucket are left out."""
    kind = F.floor(F.log(F.col("size")) / math.log(100 / percent) * 0.999).cast("int")
    members = members.withColumn("kind", kind)
    bit = "shiftleft(CAST(1 AS BIGINT), (kind + {}) & 63)".format
    # the classes of a shingle's members as bits, and those with an odd number of members
    shared = members.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.expr(f"bit_or({bit(0)})").alias("kinds"), F.expr(f"bit_xor({bit(0)})").alias("odd"))
    shared = scratch.write(shared.filter("n > 1"), "shared")
    placed = salted_join(members, shared.withColumnRenamed("n", "total"), "shingle", counts=shared)
    # others of one's class there may be where it has an even number of members, or where more are there than ones and twos explain
    twice = F.expr(f"total - bit_count(kinds) > bit_count(kinds & ~odd) OR (kinds & ~odd & {bit(0)}) <> 0")
    own, following = (F.when(twice | F.expr(f"(kinds & {bit(side)}) <> 0"), F.xxhash64("shingle", F.col("kind") + k)) for k, side in ((0, 63), (1, 1)))
    return placed.select(F.explode(F.array_compact(F.array(own, following))).alias("bucket"), "shingle", "place", "node", "size")


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    levels = spark.sparkContext.broadcast(rarity(texts, words).tobytes())
    rows = materialise(texts.mapInArrow(_prefixed(levels, words, percent), f"doc_id long, mark long, digest binary, size long, {ORDERS[0]} array<long>, bits binary"), "prefixes")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")

    with Scratch(spark) as scratch:
        nodes = rows.filter("size > 0").groupBy("digest").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("size", ORDERS[0], "bits")])
        # numbers of the nodes, fixed as the table is written
        nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        repeated = not rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()

        def sets_of(wanted: DataFrame) -> DataFrame:
            """(node, cells), written: the whole sets of the nodes of wanted, out of the texts, a row a node."""
            wanted = scratch.write(nodes.select("node", "least").join(wanted.distinct().hint("merge"), "node", "left_semi").select("node", "least.doc_id", "least.mark"), "wanted")
            made = made_of(texts, wanted, _set_rows(words), "cells binary")
            if repeated:  # rows that repeat id and text give a node more than once
                made = made.groupBy("node").agg(F.first("cells").alias("cells"))
            return scratch.write(made, "read")

        def verified(pairs: DataFrame) -> DataFrame:
            both = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
            return scratch.write(compare(pairs, sets_of(both), _linked(levels, percent), "u long, v long"), "links")

        buckets = nodes.select(F.posexplode(ORDERS[0]).alias("place", "shingle"), "node", "size")
        placed = scratch.write(bucketed(buckets, percent, scratch), "placed")
        turn = F.struct("place", F.xxhash64("node").alias("h"), F.col("node").alias("node"), F.col("size").alias("size"))
        hubs = placed.groupBy("bucket").agg(F.first("shingle").alias("shingle"), F.min(turn).alias("hub"), F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]).filter("n > 1")
        # of buckets with the same members the one first in order is kept, as it has the pairs' first common shingle
        hubs = hubs.groupBy("n", "x1", "x2").agg(F.min_by(F.struct("bucket", "hub"), F.struct(F.col("shingle").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), "bucket")).alias("k")).select("n", "k.*")
        hubs = scratch.write(hubs.select("bucket", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.place").alias("hub_place"), "n"), "hubs")
        counts = hubs.select("bucket", "n")
        members = scratch.write(salted_join(placed, hubs.drop("n"), "bucket", counts=counts).filter("node <> hub"), "members")
        fits = 100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")
        stars = scratch.write(members.filter(fits).select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct(), "pairs")
        found = components(verified(scratch.write(likely(stars, nodes, percent), "candidates")))
        # in the bucket of a pair's first common shingle what is before it differs, and the hub has the least before it
        largest = F.floor(100 * F.col("size") / percent)
        able = F.col("place") + F.col("hub_place") <= F.floor((100 - percent) * (F.col("size") + largest) / (100 + percent))
        labelled = members.filter(able).join(found.hint("merge"), "node", "left").select("bucket", "shingle", "node", "place", F.coalesce("component", "node").alias("part"))
        more = links_left(scratch.write(labelled, "labelled"), counts, nodes, percent, sets_of, levels, scratch)
        if not more.isEmpty():
            found = components(more.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        parts = nodes.select("digest", "n", "node", "least").join(found.hint("merge"), "node", "left").select("digest", "n", "least", F.coalesce("component", "node").alias("part"))
        parts = scratch.write(parts, "parts")
        tops = parts.groupBy("part").agg(F.min("least").alias("top"), F.count(F.lit(1)).alias("n"))
        classes = salted_join(parts.select("digest", "part"), tops.select("part", F.col("top.doc_id").alias("component_id")), "part", counts=tops.select("part", "n"))
        classes = materialise(classes.select("digest", "component_id"), "classes")
        full = salted_join(rows.filter("size > 0").select("doc_id", "size", "digest"), classes, "digest", counts=parts.select("digest", "n"))
        full = materialise(full.select("doc_id", F.col("size").alias("n_shingles"), "component_id"), "rows")
    return full.unionByName(rows.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) for all documents."""
    return joined(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_sort(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END) AS grams
  FROM w
), n AS (
  SELECT min(doc_id) AS node, grams, len(grams) AS size FROM s WHERE len(grams) > 0 GROUP BY grams
), e AS (
  SELECT node, size, unnest(grams) AS gram FROM n
), links AS (
  SELECT a.node AS u, b.node AS v
  FROM e a JOIN e b ON a.gram = b.gram AND a.node <> b.node AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size)
  GROUP BY a.node, b.node, a.size, b.size
  HAVING 100 * count(*) >= 90 * (a.size + b.size - count(*))
), reach AS (
  SELECT node, node AS other FROM n
  UNION
  SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.other
), c AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN n ON n.grams = s.grams LEFT JOIN c ON c.node = n.node
"""
