"""Operator 8 [native], sharding by histogram sort: all work is DataFrame code.

Each row gets a 63-bit key: 39 bits of the hash of its text, then 24 bits of the hash of its id, so equal texts are
neighbours and a hot text can still be cut. Probes are the key's bit prefixes: a round counts the exact bytes under each
child prefix of the (at most pieces - 1) prefixes in which a splitter is still undecided, and stops once every undecided
prefix holds no more bytes than the tolerance. At most FIRST + pieces * CHILD counts reach the driver in a round,
whatever the size of the input. Then rows move once. Each shard is cut into `cuts` pieces by the same splitters, so that
numbering the rows of a shard does not put the shard into one task.

The law is `bytes`: shard sizes differ from total / shards by the tolerance (0.1 % of a shard) and one row at most.

Defined cases: a null text has no bytes (size 16) and the checksum of the empty text; a null id hashes as a constant; rows
that tie in key and id follow size and checksum; more shards than rows leave shards empty; an empty table gives an empty
result. `shard` returns each row of the input as one column `document`, so that no column of it can clash with its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.llm.shared import documents, whole_row
from trawl.scratch import Scratch

SHARDS = 40
CUTS = 8
ROW_BYTES = 16
TOLERANCE = 0.001
KEY_BITS, FIRST_BITS, CHILD_BITS = 63, 13, 5


def sort_key(text, row_id) -> F.Column:
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 25), 24)
    return high.bitwiseOR(F.xxhash64(row_id).bitwiseAND(F.lit((1 << 24) - 1)))


def splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE) -> list[int]:
    """parts - 1 ascending key boundaries that part the bytes evenly; keys has _key and _size."""
    total, shift = keys.agg(F.sum("_size")).first()[0] or 0, KEY_BITS
    targets = [total * i // parts for i in range(1, parts)]
    allowed = tolerance * total / SHARDS
    #: For each target: (prefix at the present shift, bytes below it, bytes in it).
    at = {t: (0, 0, total) for t in targets}
    while shift and any(n > allowed for _, _, n in at.values()):
        open_ = sorted({p for p, _, n in at.values() if n > allowed})
        step = min(shift, FIRST_BITS if shift == KEY_BITS else CHILD_BITS)
        undecided = keys if shift == KEY_BITS else keys.filter(F.shiftright("_key", shift).isin(open_))
        found = undecided.groupBy(F.shiftright("_key", shift - step).alias("p")).agg(F.sum("_size").alias("n")).collect()
        children: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(found, key=lambda r: r["p"]):
            children.setdefault(r["p"] >> step, []).append((r["p"], r["n"]))
        shift -= step
        for t, (p, below, n) in at.items():
            if p not in children or n <= allowed:
                at[t] = (p << step, below, n)
                continue
            for child, m in children[p]:
                at[t] = (child, below, m)
                if below + m >= t:
                    break
                below += m
    edges = []
    for t, (p, below, n) in at.items():
        edges.append((p + (2 * (t - below) > n)) << shift)
    return sorted(edges)


def piece_of(key, edges: list[int]) -> F.Column:
    """Number of edges that are <= key, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(edges[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(edges))


def shard(df: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", cuts: int = CUTS, tolerance: float = TOLERANCE) -> DataFrame:
    """(document, size, crc32, key, shard, slot): document is the row of df; the rows of a shard are numbered in key order."""
    text, row_id = F.coalesce(F.col(text_column), F.lit("")), F.col(id_column)
    raw = F.encode(text, "utf-8")
    sized = df.select(whole_row(df), row_id.alias("id"), (F.length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("crc32"), sort_key(text, row_id).alias("key"))
    with Scratch(df.sparkSession) as scratch:
        keys = scratch.write(sized.select(F.col("key").alias("_key"), F.col("size").alias("_size")), "shard-keys")
        edges = splitters(keys, shards * cuts, tolerance)
        rows = {r["piece"]: r["n"] for r in keys.groupBy(piece_of(F.col("_key"), edges).alias("piece")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, ahead = [], 0
    for piece in range(shards * cuts):
        ahead = 0 if piece % cuts == 0 else ahead
        before.append(ahead)
        ahead += rows.get(piece, 0)
    order = W.partitionBy("piece").orderBy("key", "id", "size", "crc32")
    dealt = sized.withColumn("piece", piece_of(F.col("key"), edges))
    slot = F.row_number().over(order) - 1 + F.element_at(F.array(*[F.lit(int(b)) for b in before]).cast("array<bigint>"), F.col("piece") + 1)
    return dealt.select("document", "size", "crc32", "key", F.floor(F.col("piece") / cuts).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents in 40 shards, under the law `bytes`."""
    out = shard(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        F.col("document.doc_id").alias("doc_id"), "size", F.col("crc32").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_of(key: int, edges: list[int], cuts: int = CUTS) -> int:
    """The shard of one key, for readers that look up a single row."""
    from bisect import bisect_right

    return bisect_right(edges, key) // cuts
