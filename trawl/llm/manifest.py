"""Operator 12, Merkle manifest of a dataset in an external node store.

Leaves are dealt into sorted runs (range exchange by group, order and leaf) and written; the counts of runs alone number
them within their group. From there the store grows level by level in rounds: a round reads the nodes of one level in
blocks of 2^HEIGHT neighbours, folds each block up to HEIGHT levels further, and appends the nodes of each level to its
own Parquet partition `level=`; the next round reads nothing but the top level of this one, a 2^HEIGHT-th of its input. A node
is found by its coordinate (level, group, block): a row holds the nodes of one block and level in order. Proofs are
extracted downwards: each round's levels are merge-joined by block coordinate with the paths that the round above has
given to its blocks. Digests and ids are moved, never texts.

The trees of the groups (lang) hang in one more tree of the same kind, whose leaves are their roots.

Defined cases: nulls are hashed as `-`; rows of a null lang are a group, first in order; null ids come first in their group
and are not tampered with; rows that tie in id follow the digest of the leaf, and equal rows are leaves of their own; the
proof of a lone leaf in a lone group is the digest of the empty string; other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawl.llm.shared import documents
from trawl.scratch import Scratch, fresh_path, hand_out, materialise

#: Levels of a round: a block has at most 2^HEIGHT nodes.
HEIGHT = 9
#: Rows of a sorted run, about.
RUN_ROWS = 1 << 20
#: Groups and runs up to this number are broadcast.
FEW = 100_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(x: Column) -> Column:
    return F.sha2(F.encode(x, "utf-8"), 256)


def field(value: Column) -> Column:
    """A value as the leaf takes it: its UTF-8 byte count, a colon and the value, or `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(values[c]) for c in COLUMNS]))


def tampered_with(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 7 == 0, F.lit(False))


def checked(small: DataFrame) -> DataFrame:
    """small, a written table, to be broadcast where it has at most FEW rows, else for a merge join."""
    return F.broadcast(small) if small.limit(FEW + 1).count() <= FEW else small.hint("merge")


def numbered_leaves(rows: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(written rows with pos, (grp, n) of each group): pos numbers the rows of a group from 0 by order; rows has grp."""
    runs = max(1, -(-rows.count() // RUN_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["grp", *order]
    # the number of a row in its run, below the number of the run; fixed as the table is written
    dealt = rows.repartitionByRange(runs, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = scratch.write(dealt.withColumn("run", F.shiftright("at", 33).cast("int")), "runs")
    parts = dealt.groupBy("grp", "run").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(W.partitionBy("grp").orderBy("run")) - F.col("n")
    shifts = scratch.write(parts.select("grp", "run", "n", (before - F.col("first")).alias("shift")), "shifts")
    placed = dealt.join(checked(shifts.select("grp", "run", "shift")), ["grp", "run"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "run", "shift")
    return placed, shifts.groupBy("grp").agg(F.sum("n").alias("n"))


def _upwards(nodes: Column, until: Column) -> Column:
    """The levels from nodes (digests in order) upwards, at most HEIGHT more, or until one is left where `until` holds."""

    def parents(level: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: digest(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit("")))))

    def more(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        return F.when(until & (F.size(top) == 1), levels).otherwise(F.concat(levels, F.array(parents(top))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HEIGHT)), F.array(nodes), more)


class NodeStore:
    """The levels of the trees of all groups, in Parquet partitioned by level: (level, grp, block, nodes).

    nodes are neighbours in order. Those of a round are stored by its blocks; its top level, which the next round starts
    from, has one node a row, and its block is the position of this node.
    """

    SCHEMA = "grp string, block long, nodes array<string>, level int"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.rounds = spark, path, 0

    def grow(self, leaves: DataFrame, sizes: DataFrame) -> None:
        """Write all levels over leaves (grp, pos, leaf); sizes has the number n of leaves of each grp."""
        sizes, nodes = checked(sizes), leaves.select("grp", "pos", F.col("leaf").alias("node"))
        while True:
            base = self.rounds * HEIGHT
            blocks = nodes.groupBy("grp", F.shiftright("pos", HEIGHT).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("own"))
            # a group whose level fits a block ends in it; its root is not taken further
            known = blocks.join(sizes, "grp").withColumn("last", F.col("n") <= (1 << (base + HEIGHT)))
            grown = known.select("grp", "block", F.posexplode(_upwards(F.col("own.node"), F.col("last"))).alias("up", "nodes"))
            # the level that a round starts from is stored as leaves or as the top of the round before
            stored = grown.filter(F.col("up") >= F.lit(min(self.rounds, 1))).select("grp", "block", "nodes", (F.col("up") + base).alias("level"))
            stored.write.mode("append").partitionBy("level").parquet(self.path)
            self.rounds += 1
            more = sizes.filter(F.col("n") > (1 << (self.rounds * HEIGHT)))
            if more.isEmpty():
                return
            top = self.level(self.rounds * HEIGHT).join(more.select("grp"), "grp", "left_semi")
            nodes = top.select("grp", F.col("block").alias("pos"), F.get("nodes", 0).alias("node"))

    def levels(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def level(self, number: int) -> DataFrame:
        return self.levels().filter(F.col("level") == number)

    def roots(self) -> DataFrame:
        """(grp, root): the node of the highest level, which is the only one there."""
        return self.levels().filter("block = 0").groupBy("grp").agg(F.max_by(F.get("nodes", 0), "level").alias("root"))

    def paths(self) -> DataFrame:
        """(grp, block, levels, above): the levels of each block of leaves, from the leaves up, and the siblings above its top."""
        above = None
        for number in reversed(range(self.rounds)):
            base = number * HEIGHT
            read = self.levels().filter((F.col("level") >= base) & (F.col("level") <= base + HEIGHT))
            # the top of the round below is dealt to this round's blocks
            place = F.when(F.col("level") == base, F.shiftright("block", HEIGHT)).otherwise(F.col("block")) if number else F.col("block")
            rows = read.select("grp", place.alias("block"), "level", F.struct("block", "nodes").alias("row"))
            whole = rows.groupBy("grp", "block", "level").agg(F.flatten(F.array_sort(F.collect_list("row"))["nodes"]).alias("nodes"))
            blocks = whole.groupBy("grp", "block").agg(F.array_sort(F.collect_list(F.struct("level", "nodes"))).alias("own")).select("grp", "block", F.col("own.nodes").alias("levels"))
            if number:  # tops of groups that ended in the round below are roots and have nothing above
                blocks = blocks.filter(F.size("levels") > 1)
            none = F.array().cast("array<string>")
            if above is None:
                blocks = blocks.withColumn("above", none)
            else:
                blocks = blocks.join(above.hint("merge"), ["grp", "block"], "left").withColumn("above", F.coalesce("above", none))
            if not number:
                return blocks
            # the nodes that this round starts from are the tops of the blocks of the round below
            each = blocks.select("grp", "block", "levels", "above", F.posexplode(F.get("levels", 0)).alias("i", "_"))
            above = materialise(each.select("grp", (F.shiftleft("block", HEIGHT) + F.col("i")).alias("block"), F.concat(siblings(F.col("i"), F.col("levels")), "above").alias("above")), "paths")
        raise ValueError("the store is empty")


def above_by(k: Column, pos: Column) -> Column:
    """The position k levels over pos."""
    return F.call_function("shiftright", pos, k)


def siblings(at: Column, levels: Column) -> Column:
    """For each level up to the second highest the sibling of the node over leaf `at` of a block, empty where it has none."""
    lower = F.slice(levels, F.lit(1), F.size(levels) - 1)
    return F.transform(lower, lambda nodes, k: F.coalesce(F.get(nodes, above_by(k, at).bitwiseXOR(F.lit(1))), F.lit("")))


def folded(start: Column, path: Column, pos: Column) -> Column:
    """The root over a leaf at pos whose siblings are path, lowest first."""
    sides = F.transform(path, lambda s, k: F.struct(s.alias("sibling"), (above_by(k, pos) % 2 == 1).alias("right")))
    return F.aggregate(sides, start, lambda node, b: digest(F.when(b["right"], F.concat(b["sibling"], node)).otherwise(F.concat(node, b["sibling"]))))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each document."""
    spark = docs.sparkSession
    values = {c: F.col(c) for c in COLUMNS}
    changed = values | {"n_chars": F.col("n_chars") + 1}
    # a group's name sorts as lang does by its bytes, null before the empty string
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("grp")
    out_path = hand_out(spark, fresh_path(spark, "manifest"))
    with Scratch(spark) as scratch:
        hashed = docs.select(group, F.col("doc_id").cast("long").alias("doc_id"), leaf(values).alias("leaf"), F.when(tampered_with(F.col("doc_id")), leaf(changed)).alias("changed"))
        hashed = scratch.write(hashed, "leaves")
        placed, sizes = numbered_leaves(hashed, ["doc_id", "leaf"], scratch)
        leaves, sizes = scratch.write(placed, "placed"), scratch.write(sizes, "sizes")
        store = NodeStore(spark, scratch.folder("nodes"))
        store.grow(leaves, sizes)
        roots = scratch.write(store.roots(), "roots")
        tops, count = numbered_leaves(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("leaf")), ["name"], scratch)
        tops = scratch.write(tops, "tops")
        upper = NodeStore(spark, scratch.folder("top-nodes"))
        upper.grow(tops, scratch.write(count, "groups"))
        root = upper.roots().select("root").first()
        over = upper.paths().select("block", "levels", "above", F.posexplode(F.get("levels", 0)).alias("i", "_"))
        over = over.select((F.shiftleft("block", HEIGHT) + F.col("i")).alias("pos"), F.concat(siblings(F.col("i"), F.col("levels")), "above").alias("over"))
        groups = scratch.write(tops.join(over, "pos").select(F.col("name").alias("grp"), F.col("pos").alias("place"), F.col("leaf").alias("subroot"), "over"), "over")
        within = F.struct("pos", "doc_id", "leaf", "changed")
        own = leaves.groupBy("grp", F.shiftright("pos", HEIGHT).alias("block")).agg(F.collect_list(within).alias("rows"))
        joined = own.join(store.paths(), ["grp", "block"]).join(checked(groups), "grp")
        each = joined.select("subroot", "place", "over", "levels", "above", F.explode("rows").alias("r"))
        inside = F.col("r.pos").bitwiseAND(F.lit((1 << HEIGHT) - 1).cast("long")).cast("int")
        path = each.select("subroot", "place", "over", "r", F.concat(siblings(inside, F.col("levels")), "above").alias("path"))
        start = F.coalesce("r.changed", "r.leaf")
        done = path.select(
            F.col("r.doc_id").alias("doc_id"), F.col("r.leaf").alias("leaf"), "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"),
            digest(F.concat(F.array_join("path", ""), F.array_join("over", ""))).alias("proof_sha256"),
            folded(folded(start, F.col("path"), F.col("r.pos")), F.col("over"), F.col("place")).alias("folded_root"),
        )
        done.withColumn("verified", F.col("folded_root") == F.col("root")).write.parquet(out_path)
    return spark.read.schema("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").parquet(out_path)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    return manifest(documents(spark, sf_dir))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(n_chars if c == "n_chars" else c) for c in COLUMNS) + ")"


#: DuckDB has no crc32, so the checksum goes over the id's digits bit by bit.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + 1)")} AS changed,
         xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b:
           list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), 4294967295), 4294967295) % 7 = 0 AS bad
  FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, coalesce('=' || lang, '') AS grp FROM d
), tree AS (
  SELECT grp, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY grp) AS n FROM n
  UNION ALL
  SELECT grp, level + 1, pos // 2, sha256(node || coalesce(mate, '')), (n + 1) // 2
  FROM (SELECT *, lead(node) OVER (PARTITION BY grp ORDER BY pos) AS mate FROM tree WHERE n > 1)
  WHERE pos % 2 = 0
), sub AS (
  SELECT grp, node AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS place FROM tree WHERE n = 1
), upper AS (
  SELECT 0 AS level, place AS pos, subroot AS node, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, sha256(node || coalesce(mate, '')), (n + 1) // 2
  FROM (SELECT *, lead(node) OVER (ORDER BY pos) AS mate FROM upper WHERE n > 1)
  WHERE pos % 2 = 0
), walk AS (
  SELECT n.doc_id, n.grp, n.leaf, n.pos AS at, n.pos AS id, 0 AS level, CASE WHEN coalesce(bad, false) THEN changed ELSE leaf END AS now, '' AS proof
  FROM n
  UNION ALL
  SELECT w.doc_id, w.grp, w.leaf, w.at // 2, w.id, w.level + 1,
         sha256(CASE WHEN w.at % 2 = 1 THEN coalesce(s.node, '') || w.now ELSE w.now || coalesce(s.node, '') END), w.proof || coalesce(s.node, '')
  FROM walk w JOIN tree t ON t.grp = w.grp AND t.level = w.level AND t.pos = w.at AND t.n > 1
  LEFT JOIN tree s ON s.grp = w.grp AND s.level = w.level AND s.pos = xor(w.at, 1)
), whole AS (
  SELECT w.doc_id, w.grp, w.leaf, w.id, sub.subroot, sub.place AS at, 0 AS level, w.now, w.proof
  FROM walk w JOIN tree t ON t.grp = w.grp AND t.level = w.level AND t.pos = w.at AND t.n = 1 JOIN sub ON sub.grp = w.grp
  UNION ALL
  SELECT w.doc_id, w.grp, w.leaf, w.id, w.subroot, w.at // 2, w.level + 1,
         sha256(CASE WHEN w.at % 2 = 1 THEN coalesce(s.node, '') || w.now ELSE w.now || coalesce(s.node, '') END), w.proof || coalesce(s.node, '')
  FROM whole w JOIN upper t ON t.level = w.level AND t.pos = w.at AND t.n > 1
  LEFT JOIN upper s ON s.level = w.level AND s.pos = xor(w.at, 1)
)
SELECT w.doc_id, w.leaf, w.subroot, u.node AS root, sha256(w.proof) AS proof_sha256, w.now AS folded_root, w.now = u.node AS verified
FROM whole w JOIN upper u ON u.level = w.level AND u.n = 1
"""
