"""Operator 9, exact dedup: a persistent digest index, bucketed and sorted by digest.

A batch of documents is reduced to one row per digest (pre-aggregated before its only exchange), anti-joined by sort-merge
with the index, and the new digests are appended to it. Running a batch again adds nothing, so a job that died half-way
can be repeated. Only digests and ids are shuffled, never texts. The index lives at a path that all executors share and is
opened from there by any session; which of its generations counts is said by a pointer that is written last, so a
compaction that dies at any step leaves the old or the new one whole.

Defined cases: a null text counts as the empty text; of equal texts the row with the smallest doc_id stays; rows that
repeat one doc_id and text share its fate, as do rows whose doc_id is null where no other id exists (keep_id is null then
and they stay) in op9_exact_dedup, as its SQL has it; the pipeline's stage keeps exactly one row of each group. Other columns
are ignored. An empty table gives an empty result and an unchanged index.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.shared import documents, first_rows, salted_join
from trawl.scratch import Scratch, fresh_path, materialise, remove

#: Appends after which the index is rewritten.
COMPACT_AFTER = 16
INDEX_SCHEMA = "digest binary, keep_id long, batch long"
SPACES = r"[\x20\x09-\x0D]+"


def normalised_digest(text) -> F.Column:
    """SHA-256 of the text in UTF-8 with each run of white space replaced by one space; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), "utf-8"), 256))


class DigestIndex:
    """Rows (digest binary, keep_id long, batch long), bucketed and sorted by digest, below a path.

    The path holds generations, folders of bucketed files that appends add to, and pointers `_current-<number>` that are
    made once and never changed: the highest one that is whole names the generation that counts and its buckets. A session
    reads a generation as an external table, which it declares anew where its catalog does not know it.

    An append takes the next number of its generation first. If it dies half-way, the rows that it left are right by
    themselves, and running the batch again keeps what it kept. Where two jobs that ran at once both appended a digest,
    `rows` takes the earlier batch, then the smaller id. After COMPACT_AFTER appends a new generation is written with one
    sorted file a bucket; nothing else may add to the index meanwhile. Generations that no pointer names any more, those of
    broken compactions too, are removed by the next compaction.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._current() is None:
            self._commit(0, spark.createDataFrame([], INDEX_SCHEMA), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        _, self.generation, self.buckets = self._current()

    # files

    def _names(self, folder: str, prefix: str) -> list[str]:
        at = self._paths(folder)
        found = self._files.listStatus(at) if self._files.exists(at) else ()
        return sorted(n for n in (f.getPath().getName() for f in found) if n.startswith(prefix))

    def _make(self, name: str, content: str) -> None:
        """A file that was not there, else an error."""
        out = self._files.create(self._paths(f"{self.path}/{name}"), False)
        out.write(bytearray(content.encode()))
        out.close()

    def _current(self) -> tuple[int, str, int] | None:
        """(number, generation, buckets) of the highest pointer that is whole."""
        for name in reversed(self._names(self.path, "_current-")):
            stream = self._files.open(self._paths(f"{self.path}/{name}"))
            said = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if said.endswith("\n"):
                generation, buckets = said.split()
                return int(name.rpartition("-")[2]), generation, int(buckets)
        return None

    def _pointers(self) -> int:
        return max((int(n.rpartition("-")[2]) for n in self._names(self.path, "_current-")), default=0)

    # tables

    def _table(self, generation: str, buckets: int) -> str:
        """The name of a generation's table in this session's catalog."""
        folder = f"{self.path}/{generation}"
        table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"
        if not self.spark.catalog.tableExists(table) and self._files.exists(self._paths(folder)):
            self.spark.sql(f"CREATE TABLE {table} ({INDEX_SCHEMA.replace(' long', ' bigint')}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'")
        return table

    def _write(self, rows: DataFrame, generation: str, buckets: int) -> None:
        table = self._table(generation, buckets)
        dealt = rows.select("digest", "keep_id", "batch").repartition(buckets, "digest")
        dealt.write.mode("append").format("parquet").bucketBy(buckets, "digest").sortBy("digest").option("path", f"{self.path}/{generation}").saveAsTable(table)

    def _commit(self, number: int, rows: DataFrame, buckets: int) -> None:
        """Write rows as a new generation, then the pointer after number."""
        generation = f"generation-{uuid.uuid4().hex}"
        self._write(rows, generation, buckets)
        self._point(number + 1, generation, buckets)

    def _point(self, number: int, generation: str, buckets: int) -> None:
        self._make(f"_current-{number:010d}", f"{generation} {buckets}\n")

    # rows

    def known(self) -> DataFrame:
        return self.spark.table(self._table(self.generation, self.buckets))

    def rows(self) -> DataFrame:
        """(digest, keep_id), one row a digest; buckets are read in place, without an exchange."""
        first = F.min(F.struct("batch", "keep_id"))
        return self.known().groupBy("digest").agg(first.alias("first")).select("digest", F.col("first.keep_id").alias("keep_id"))

    def add(self, groups: DataFrame) -> None:
        """Append the digests of groups (digest, keep_id) that the index does not hold yet."""
        appends = self._appends()
        number = appends + 1
        # a number is taken by a file; rows of a compaction have number 0
        self._make(f"{self.generation}/_append-{number:010d}", "")
        batch = F.lit(number).cast("long").alias("batch")
        self._write(groups.hint("merge").join(self.known().hint("merge"), "digest", "left_anti").select("digest", "keep_id", batch), self.generation, self.buckets)
        if number >= COMPACT_AFTER:
            self.compact()

    def _appends(self) -> int:
        return max((int(n.rpartition("-")[2]) for n in self._names(f"{self.path}/{self.generation}", "_append-")), default=0)

    def compact(self) -> None:
        """Write a new generation with one sorted file a bucket, point to it, and remove all others."""
        self._commit(self._pointers(), self.rows().withColumn("batch", F.lit(0).cast("long")), self.buckets)
        _, self.generation, _ = self._current()
        for name in self._names(self.path, "generation-"):
            if name != self.generation:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name, self.buckets)}")
                remove(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        """Remove the index and its files."""
        for name in self._names(self.path, "generation-"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name, self.buckets)}")
        remove(self.spark, self.path)


def _hashed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, mark, digest) of each row, written; mark is a hash of the text as it stands, which tells rows of one id apart."""
    text = F.col(text_column)
    return materialise(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), normalised_digest(text).alias("digest")), "digests")


def _resolved(hashed: DataFrame, index: DigestIndex) -> DataFrame:
    """(digest, keep_id, group_size, least_id, least_mark) of each digest, written, after the index has taken the new ones:
    least_id and least_mark are of the batch's row with the smallest id, then mark."""
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    with Scratch(hashed.sparkSession) as scratch:
        groups = hashed.groupBy("digest").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("group_size"))
        groups = scratch.write(groups.select("digest", F.col("least.id").alias("least_id"), F.col("least.mark").alias("least_mark"), "group_size"), "groups")
        index.add(groups.select("digest", F.col("least_id").alias("keep_id")))
        return materialise(groups.hint("merge").join(index.rows().hint("merge"), "digest"), "resolved")


def dedup(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for each row of docs; new digests go to the index.

    keep_id is the document that the index holds for the digest: of an earlier batch if there is one, else the smallest id
    of this batch. group_size counts the rows of this batch. The result does not read the index any more.
    """
    hashed = _hashed(docs, id_column, text_column)
    resolved = _resolved(hashed, index).select("digest", "keep_id", "group_size")
    rows = salted_join(hashed.select("doc_id", "digest"), resolved, "digest", counts=resolved.select("digest", F.col("group_size").alias("n")))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def unique_rows(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that the index has no equal text for, exactly one of each group of equal texts: one with the smallest id."""
    hashed = _hashed(docs, id_column, text_column)
    resolved = _resolved(hashed, index)
    # most texts are alone and new, and stay without a look
    moved = resolved.filter("group_size > 1 OR NOT keep_id <=> least_id")
    rows = salted_join(hashed, moved, "digest", counts=moved.select("digest", F.col("group_size").alias("n")))
    first = F.col("keep_id").eqNullSafe(F.col("least_id")) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("least_mark"))
    return first_rows(docs, rows.select("doc_id", "mark", first.alias("first")), id_column, text_column)


def _own_index(spark: SparkSession, work: Callable[[DigestIndex], DataFrame]) -> DataFrame:
    """The result of work with an index of its own that starts empty and goes again."""
    index = DigestIndex(spark, fresh_path(spark, "digest-index"))
    try:
        return work(index)
    finally:
        index.drop()


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest columns for all documents, against an index that starts empty."""
    out = _own_index(spark, lambda index: dedup(documents(spark, sf_dir), index))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: exactly one row of each group of equal texts, with its own columns: one with the smallest doc_id."""
    return _own_index(spark, lambda index: unique_rows(docs, index))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
