"""Operator 6, near duplicates by DartMinHash signatures and banded joining.

A document is a weighted set: its shingles of five words (white-space separated, ASCII lower case), weighted by how often
they occur; similarity is the weighted Jaccard coefficient, sum of minima over sum of maxima. Each element owns a region,
its weight times the rank axis, cut into unit cells; a cell's hash gives a Poisson number of darts with a coordinate and a
rank each. Darts up to the rank DARTS / weight are thrown, so a document gets about k ln k + 2k of them whatever its
length, and a coordinate keeps its earliest dart; documents with an empty coordinate are thrown again, twice as far.
(Published: Christiani, "DartMinHash: fast sketching for weighted sets", 2020.)

Exact copies (equal word sequences) are one node. Per band a bucket's members are compared with one hub, picked by a hash
that differs by band, so a large group is linked by stars over many hubs and its pairs are never listed. Buckets that still
hold several components are then searched for links that no hub saw: the members outside the bucket's largest component
meet all others, block by block. Inside a block a pair is left out only where it cannot reach the threshold: by the numbers
of cells, or since the bitmaps of both (parities of hashed cells) differ in more bits than so many cells could. Pairs never
become rows; of the links between two components a block returns one. All comparisons are exact and over whole texts.
Components are the classes.

Chance of missing a pair of similarity 0.8: (1 - 0.8^6)^32 = 0.00006, less above; nothing else can lose a link.

Defined cases: a text of fewer than five words is one shingle; texts without words are copies of each other; rows whose id is
null are compared as all others, and where a class has no other its id is null; rows that repeat an id are told apart by their
texts, so each has the class of its own text; rows that repeat id and text have one class; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.components import components
from trawl.llm.shared import LOWER, bounded_batches, documents, first_rows, made_of, mix64, powers, salted_join, slices, trimmed
from trawl.scratch import Scratch, materialise

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 32
COORDINATES = ROWS * BANDS
DARTS = COORDINATES * np.log(COORDINATES) + 2 * COORDINATES
#: Members of a bucket that are compared with as many others at once.
BLOCK = 512
#: Bits of a bitmap: twice the cells of the larger text, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 17

_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, n + 1, dtype=float)) for n in range(19)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, owner, digests): all shingles of each text, sorted by owner and value, and a hash of each text's words."""
    n, docs = len(data), len(offsets) - 1
    if n:
        space = _SPACE[data]
        first = ~space
        first[1:] &= space[:-1]
        heads = offsets[:-1][offsets[:-1] < n]
        first[heads] |= ~space[heads]
        starts = np.flatnonzero(first)
        last = np.ones(n, bool)
        last[:-1] = space[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = True
        ends = np.flatnonzero(last & ~space) + 1
        power, inverse = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(LOWER[data] * power[:n], out=sums[1:])
        word = mix64((sums[ends] - sums[starts]) * inverse[starts])
        bounds = np.searchsorted(starts, offsets)
    else:
        word, bounds = np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(docs), counts)
    place = np.arange(len(word)) - bounds[owner] if len(word) else np.zeros(0, np.int64)
    # the digest of the word sequence: two sums over words and places
    digests = np.zeros((docs, 2), np.uint64)
    for j in range(2):
        said = mix64(word * np.uint64(2 * j + 1) + mix64(place.astype(np.uint64) + np.uint64(j + 1)) * _STEP)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(said, dtype=np.uint64)])
        digests[:, j] = mix64(total[bounds[1:]] - total[bounds[:-1]] + counts.astype(np.uint64))
    shingle = np.zeros(len(word), np.uint64)
    for j in range(words):
        moved = np.concatenate([word[j:], np.zeros(min(j, len(word)), np.uint64)])
        inside = place + j < counts[owner]
        shingle = shingle * _STEP + np.where(inside, moved, np.uint64(j + 1))
    keep = (place + words <= counts[owner]) | ((place == 0) & (counts[owner] < words))
    shingle, owner = mix64(shingle[keep]), owner[keep]
    order = np.lexsort((shingle, owner))
    return shingle[order], owner[order], digests


def cells(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, bounds, digests): the unit-weight cells (shingle, occurrence) of each text, and a hash of its words."""
    shingle, owner, digests = shingles(data, offsets, words)
    docs = len(offsets) - 1
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    group = np.flatnonzero(fresh)
    nth = np.arange(len(shingle)) - np.repeat(group, np.diff(np.append(group, len(shingle))))
    keys = mix64(shingle + nth.astype(np.uint64) * _STEP)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=docs))]).astype(np.int64)
    return keys, bounds, digests


def signatures(keys: np.ndarray, bounds: np.ndarray, k: int = COORDINATES, darts: float = DARTS, parts: np.ndarray | None = None) -> np.ndarray:
    """The earliest dart (rank in the high 40 bits, identity below) of each coordinate; all ones where a text has no cell.

    An element's region is made of cells of weight 1; the last one of an element whose weight isn't whole has a part in
    (0, 1) and holds the darts whose place in the cell lies below it. Without parts all cells are whole.
    """
    docs = len(bounds) - 1
    out = np.full((docs, k), _NONE, np.uint64)
    number_of = np.diff(bounds)
    weight = number_of.astype(float) if parts is None else np.diff(np.concatenate([[0.0], np.cumsum(parts)])[bounds])
    todo, reach = np.flatnonzero(number_of), float(darts)
    while len(todo):
        depth = np.ceil(reach / weight[todo]).astype(np.int64)
        for at in _portions(number_of[todo] * depth):
            own, deep = todo[at], depth[at]
            size = number_of[own] * deep
            row = np.repeat(np.arange(len(own)), size)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            cell = bounds[own][row] + nth // deep[row]
            level = (nth % deep[row]).astype(np.uint64)
            seed = mix64(keys[cell] + (level + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
            number = np.searchsorted(_POISSON, (seed >> np.uint64(11)) * 2.0**-53, "right")
            dart_row, dart_level, dart_seed, dart_cell = (np.repeat(x, number) for x in (row, level, seed, cell))
            turn = np.arange(len(dart_row)) - np.repeat(np.cumsum(number) - number, number)
            dart = mix64(dart_seed + (turn.astype(np.uint64) + np.uint64(1)) * _STEP)
            rank = dart_level.astype(float) + (dart >> np.uint64(32)) * 2.0**-32
            near = rank <= reach / weight[own][dart_row]
            if parts is not None:
                near &= (mix64(dart + _STEP) >> np.uint64(11)) * 2.0**-53 < parts[dart_cell]
            dart, rank, dart_row = dart[near], rank[near], dart_row[near]
            other = mix64(dart ^ np.uint64(0x94D049BB133111EB))
            slot = (other >> np.uint64(40)) % np.uint64(k)
            value = (np.minimum(rank * 2.0**26, 2.0**40 - 1).astype(np.uint64) << np.uint64(24)) | (other & np.uint64(0xFFFFFF))
            flat = np.full(len(own) * k, _NONE, np.uint64)
            np.minimum.at(flat, dart_row * k + slot.astype(np.int64), value)
            out[own] = flat.reshape(-1, k)
        todo = todo[(out[todo] == _NONE).any(axis=1)]
        reach *= 2
    return out


def _portions(sizes: np.ndarray, limit: int = 1 << 20) -> Iterator[slice]:
    """Slices of rows whose sizes add up to about limit."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield slice(at, to)
        at = to


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band of ROWS coordinates."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    part = signature.reshape(-1, BANDS, ROWS)
    for j in range(ROWS):
        out = mix64(out * _STEP + part[:, :, j] + np.uint64(j + 1))
    return mix64(out + np.arange(BANDS, dtype=np.uint64) * _STEP)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with trimmed():
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(2)):
                keys, bounds, digests = cells(data, offsets)
                signature = signatures(keys, bounds)
                bands = pa.ListArray.from_arrays(np.arange(0, (to - at) * BANDS + 1, BANDS, dtype=np.int32), pa.array(band_keys(signature).view(np.int64).ravel()))
                own = pa.array([d.tobytes() for d in digests], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[:2]), own, pa.array(np.diff(bounds) > 0), bands], ["doc_id", "mark", "digest", "worded", "bands"])


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with trimmed():
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(2)):
                keys, bounds, _ = cells(data, offsets)
                own = [np.sort(keys[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[:2]), pa.array(own, pa.binary())], ["doc_id", "mark", "cells"])


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard coefficient of two lists of cells."""
    if not len(x) and not len(y):
        return 1.0
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with trimmed():
        for batch in batches:
            values = [similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], ["u", "v", "similarity"])


def compare(pairs: DataFrame, cells: DataFrame, work=_compare, columns: str = "u long, v long, similarity double") -> DataFrame:
    """(u, v, similarity), or what else work makes, of each pair (u, v) of a written table, exact over the whole texts; a hub may
    be in many pairs."""
    left, right = cells.select(F.col("node").alias("u"), F.col("cells").alias("cu")), cells.select(F.col("node").alias("v"), F.col("cells").alias("cv"))
    half = salted_join(pairs, left, "u")
    both = salted_join(half, right, "v", counts=pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    return both.select("u", "v", "cu", "cv").mapInArrow(work, columns)


def bitmaps(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """For each list of cells the parities of the numbers of its cells with a hash in each of `bits` places, as words."""
    out = np.zeros((len(cells), bits >> 6), np.uint64)
    at = np.concatenate(cells) & np.uint64(bits - 1)
    row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    np.bitwise_xor.at(out, (row, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return out


def possible_pairs(cells: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (p of left, q of right) without those that cannot reach the threshold.

    With a similarity of t or more, sizes a <= b obey a >= t b, and at most (1 - t) / (1 + t) (a + b) cells are in only one of
    the two, each of which changes one bit of the parities.
    """
    size = np.array([len(c) for c in cells])
    slack = (1 - threshold) / (1 + threshold)
    classes = np.ceil(np.log2(np.maximum(size[left], 1))).astype(int)
    for c in np.unique(classes):
        own = left[classes == c]
        near = right[(size[right] >= threshold * size[own].min() - 1e-9) & (size[right] * threshold <= size[own].max() + 1e-9)]
        if not len(near):
            continue
        bits = int(np.clip(2 << c, LEAST_BITS, MOST_BITS))
        ours, theirs = bitmaps([cells[k] for k in own], bits), bitmaps([cells[k] for k in near], bits)
        step = max(1, (1 << 22) // theirs.size)
        for at in range(0, len(own), step):
            p = own[at : at + step]
            differ = np.bitwise_count(ours[at : at + step, None, :] ^ theirs[None, :, :]).sum(axis=2, dtype=np.int64)
            a, b = size[p][:, None], size[near][None, :]
            x, y = np.nonzero((differ <= slack * (a + b) + 1e-9) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9))
            yield p[x], near[y]


def _links_between(table: pa.Table, threshold: float) -> pa.Table:
    """A link (u, v) for each two components that are linked within one block pair; rows (bucket, i, j, sub, part, bands, cells).

    A pair that shares several buckets is compared in the first band of them.
    """
    us, vs = [], []
    if table.num_rows:
        bucket, i, j = (table[c][0].as_py() for c in ("bucket", "i", "j"))
        sub, part = (np.asarray(table[c].combine_chunks()) for c in ("sub", "part"))
        bands = np.asarray(table["bands"].combine_chunks().flatten(), np.int64).reshape(-1, BANDS)
        cells = [np.frombuffer(c, np.uint64) for c in table["cells"].to_pylist()]
        band, known = int(np.flatnonzero(bands[0] == bucket)[0]), set()
        for p, q in possible_pairs(cells, np.flatnonzero(sub == i), np.flatnonzero(sub == j), threshold):
            fine = part[p] != part[q]
            if i == j:
                fine &= p < q
            p, q = p[fine], q[fine]
            first = np.argmax(bands[p] == bands[q], axis=1) == band
            for m, n in zip(p[first].tolist(), q[first].tolist(), strict=True):
                link = (min(part[m], part[n]), max(part[m], part[n]))
                if link not in known and similarity(cells[m], cells[n]) >= threshold:
                    known.add(link)
                    us.append(link[0])
                    vs.append(link[1])
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def block_pairs(labelled: DataFrame, counts: DataFrame, known: DataFrame, size: int | None = None) -> DataFrame:
    """The members of buckets that hold several parts, once for each pair (i, j) of blocks of their bucket that they are in,
    sub being their own block: labelled's columns but node, i, j, sub and known's columns but node.

    labelled is a written table (bucket, node, part), counts has at least the members n of each bucket, known is by node.
    The members of a bucket's largest part are cut into blocks (of `size`, else BLOCK) that meet only the blocks of the others.
    """
    size = size or BLOCK
    parts = labelled.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("m"))
    largest = F.max(F.struct("m", "part"))
    mixed = parts.groupBy("bucket").agg(largest.alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("n")).filter("parts > 1")
    blocks = lambda rows: F.ceil(rows / size).cast("int")
    mixed = mixed.select("bucket", F.col("top.part").alias("main"), blocks(F.col("n") - F.col("top.m")).alias("minor"), blocks(F.col("top.m")).alias("major"))
    members = salted_join(labelled, mixed, "bucket", counts=counts)
    own = F.col("part") == F.col("main")
    dealt = F.pmod(F.xxhash64("node"), F.when(own, F.col("major")).otherwise(F.col("minor"))).cast("int") + F.when(own, F.col("minor")).otherwise(0)
    others = F.sequence(F.lit(0), F.col("minor") - 1 + F.when(own, 0).otherwise(F.col("major")))
    carried = [c for c in labelled.columns if c != "node"]
    facts = [c for c in known.columns if c != "node"]
    full = members.select(*carried, "node", dealt.alias("sub"), others.alias("others")).join(known.hint("merge"), "node")
    keyed = full.select(*carried, "sub", *facts, F.explode("others").alias("other"))
    return keyed.select(*carried, F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", *facts)


def links_left(labelled: DataFrame, counts: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links between the components of a bucket, for buckets that hold several; pairs stay inside a task. Arguments
    are those of block_pairs, with known (node, bands, cells)."""
    keyed = block_pairs(labelled, counts, known).select("bucket", "i", "j", "sub", "part", "bands", "cells")
    return keyed.groupBy("bucket", "i", "j").applyInArrow(lambda t: _links_between(t, threshold), "u long, v long").distinct()


def near_classes(docs: DataFrame, threshold: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, mark, class_id, first) for each row of docs: mark is a hash of the text, class_id the least id of the class,
    first is true for the row with this id (of several, with the least mark)."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    sketched = materialise(texts.mapInArrow(_sketch, "doc_id long, mark long, digest binary, worded boolean, bands array<long>"), "sketches")
    with Scratch(docs.sparkSession) as scratch:
        row = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))
        nodes = sketched.groupBy("digest").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("n"), F.first("worded").alias("worded"), F.first("bands").alias("bands"))
        # numbers of the nodes, fixed as the table is written
        nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        worded = nodes.filter("worded")

        buckets = worded.select(F.explode("bands").alias("bucket"), "node")
        turn = F.struct(F.xxhash64("node", "bucket").alias("h"), F.col("node").alias("node"))
        hubs = scratch.write(buckets.groupBy("bucket").agg(F.min(turn).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", F.col("hub.node").alias("hub"), "n"), "hubs")
        counts = hubs.select("bucket", "n")
        placed = scratch.write(salted_join(buckets, hubs.drop("n"), "bucket", counts=counts), "buckets")
        pairs = scratch.write(placed.filter("node <> hub").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct(), "pairs")
        known = worded.select("node", "bands", "least").join(placed.select("node").distinct().hint("merge"), "node", "left_semi")
        wanted = scratch.write(known.select("node", "least.doc_id", "least.mark"), "wanted")
        cells = made_of(texts, wanted, _cell_rows, "cells binary")
        if not sketched.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            # rows that repeat id and text give a node its cells more than once
            cells = cells.groupBy("node").agg(F.first("cells").alias("cells"))
        cells = scratch.write(cells, "cells")
        links = scratch.write(compare(pairs, cells).filter(F.col("similarity") >= threshold).select("u", "v"), "links")
        found = components(links)

        # what a hub was compared with needs no second look, so buckets of two are done
        rest = placed.filter("node <> hub").select("bucket", "node")
        labelled = rest.join(found.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))
        labelled = scratch.write(labelled, "labelled")
        known = scratch.write(known.select("node", "bands").join(cells.hint("merge"), "node"), "known")
        for done in (placed, pairs, links, cells):
            scratch.drop(done)
        more = scratch.write(links_left(labelled, counts, known, threshold), "more")
        parts = nodes.select("digest", "node", "least").join(found.hint("merge"), "node", "left").select("digest", "least", F.coalesce("component", "node").alias("part"))
        merged = components(more).select(F.col("node").alias("part"), "component")
        parts = salted_join(scratch.write(parts, "parts"), merged, "part", "left").select("digest", "least", F.coalesce("component", "part").alias("part"))
        parts = scratch.write(parts, "merged")
        tops = parts.groupBy("part").agg(F.min("least").alias("top"), F.count(F.lit(1)).alias("n"))
        classes = materialise(salted_join(parts.select("digest", "part"), tops.select("part", "top"), "part", counts=tops.select("part", "n")).select("digest", F.col("top.doc_id").alias("class_id"), F.col("top.mark").alias("top_mark")), "classes")
        rows = salted_join(sketched.select("doc_id", "mark", "digest"), classes, "digest", counts=nodes.select("digest", "n"))
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("top_mark"))
    return rows.select("doc_id", "mark", "class_id", first.alias("first"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, kept) for all documents; one of each class is kept, that with the least id."""
    return near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", F.col("first").alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: exactly one row of each class, that with the least id, with its own columns."""
    return first_rows(docs, near_classes(docs).select("doc_id", "mark", "first"))
