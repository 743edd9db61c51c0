"""Exact deduplication against a persistent index of text digests.

The index is a table of digests, bucketed and sorted by digest.  A batch is reduced to one row per digest
before it meets the index in a sort-merge anti-join; digests that the index lacks are appended.  Texts never
move: only digests, 64 characters each, are shuffled.

Every digest carries the id of the batch that brought it.  A batch does not meet what it brought itself and appends only
what is missing of it, so a batch that is run again under its id, because the job ended before its result was
written, gives the same rows and changes nothing.  ``compact`` rewrites the index to one sorted file per bucket.

Defined results: a null text counts as empty, so all null and empty texts are equal.  A null doc_id is smaller
than any other.  Of rows with the same text and the same doc_id one is kept.  Columns other than doc_id and
text are ignored, whatever their names.  An empty batch gives no rows and leaves the index as it is.  A text of any length
is one digest.  A batch id stands for the same rows each time; without one a batch is always a new one.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstat.llm.frames import small
from gavelstat.workspace import drop_at_exit, new_path

ENTRY = "digest string, keep_id bigint, batch string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower case for A-Z alone; ``lower`` does just that where every character is one byte."""
    known = F.coalesce(text, F.lit(""))
    return F.when(F.length(known) == F.octet_length(known), F.lower(known)).otherwise(
        F.translate(known, UPPER, LOWER)
    )


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """Digests of all texts that were ever kept, with the doc_id that stands for each."""

    #: Whether the files go with the session.
    temporary = False

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        """``name``: of the catalog table; ``path``: where its files are (default: the warehouse).

        ``buckets`` should suit the size the index will reach, not that of a batch.
        """
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            if spark.catalog.tableExists(self._merged):  # a compaction ended between its last two steps
                spark.sql(f"ALTER TABLE {self._merged} RENAME TO {name}")
            else:
                self._append(spark.createDataFrame([], ENTRY))

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame, batch_id: str | None = None, steps: int = 1) -> DataFrame:
        """Append the batch's new digests; one row per row of the batch tells what stays.

        Columns: doc_id, keep_id (of the row that stays, maybe one of an earlier batch), group_size (equal rows
        of this batch), kept, text_sha256.

        A batch may go in by ``steps``, even ranges of doc_id, the largest first: a step finds what those before it have
        appended, and the result is that of one step.  Each is a batch to the index, so that a load that is stopped
        goes on where it was.
        """
        batch_id = batch_id or uuid.uuid4().hex
        digests = batch.select("doc_id", text_digest(F.col("text")).alias("digest"))
        rows = small(digests.groupBy("digest", "doc_id").agg(F.count("*").alias("alike")), "digests")
        decided = [
            self._decide(rows.filter(part), f"{batch_id}/{n}") for n, part in enumerate(_ranges(rows, steps))
        ]
        if steps > 1:
            every = reduce(DataFrame.unionByName, decided)
            each = every.groupBy("digest").agg(
                F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.bool_or("fresh").alias("fresh")
            )
            decided = [small(each, "decided")]
        # a hot digest has many rows on one side alone: both sides are plain scans, which adaptive execution splits
        judged = rows.join(decided[0], "digest")
        return judged.select(
            "*", F.posexplode(F.sequence(F.lit(1).cast("bigint"), F.col("alike"))).alias("copy", "nth")
        ).select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )

    def _decide(self, rows: DataFrame, batch_id: str) -> DataFrame:
        """One row per digest, its new ones appended: keep_id, group_size and whether the batch brought it."""
        groups = rows.groupBy("digest").agg(F.max("doc_id").cast("bigint").alias("keep_id"), F.sum("alike").alias("group_size"))
        fresh = small(self._unseen(groups, batch_id).withColumn("fresh", F.lit(True)), "fresh")
        known = self._others(batch_id).select("digest", "keep_id")
        seen = small(groups.drop("keep_id").join(known, "digest").withColumn("fresh", F.lit(False)), "seen")
        self._bring(fresh.select("digest", "keep_id"), batch_id)
        return fresh.unionByName(seen)

    def keep_new(self, docs: DataFrame, batch_id: str | None = None) -> DataFrame:
        """The rows of ``docs``, all columns, that stay; their digests join the index.

        Rows equal in text and doc_id are told apart by a hash over all columns; fully equal rows become one.
        """
        batch_id = batch_id or uuid.uuid4().hex
        digest, mark = "_exact_digest", "_exact_row"
        rows = docs.withColumns({digest: text_digest(F.col("text")), mark: F.xxhash64(*docs.columns)})
        best = rows.groupBy(F.col(digest).alias("digest")).agg(F.max(F.struct("doc_id", mark)).alias("best"))
        best = small(self._unseen(best, batch_id), "fresh")
        self._bring(best.select("digest", F.col("best.doc_id").alias("keep_id")), batch_id)
        stay = best.select(F.col("digest").alias(digest), F.col(f"best.{mark}").alias(mark))
        return rows.join(stay, [digest, mark], "left_semi").dropDuplicates([digest, mark]).drop(digest, mark)

    def compact(self) -> None:
        """One sorted file per bucket; while it runs nothing may be added.

        The new table is whole before the old one goes; where the job ends between the two, the next
        ``DigestIndex`` of this name, or the next compaction, finishes or repeats it.
        """
        old = self.path
        self.spark.sql(f"DROP TABLE IF EXISTS {self._merged}")
        self.path = f"{old}-{uuid.uuid4().hex}" if old else None
        self._append(self.entries(), self._merged)
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {self._merged} RENAME TO {self.name}")
        if old:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            if self.temporary:
                drop_at_exit(self.spark, self.path)

    @property
    def _merged(self) -> str:
        return f"{self.name}_merged"

    def _others(self, batch_id: str) -> DataFrame:
        return self.entries().filter(F.col("batch") != batch_id)

    def _unseen(self, groups: DataFrame, batch_id: str) -> DataFrame:
        """Sort-merge anti-join; without the hint an index that is small today would be broadcast."""
        return groups.hint("merge").join(self._others(batch_id).select("digest"), "digest", "left_anti")

    def _bring(self, entries: DataFrame, batch_id: str) -> None:
        """Append what the batch brings, but for what an earlier run of it has appended."""
        own = self.entries().filter(F.col("batch") == batch_id).select("digest")
        if not own.isEmpty():
            entries = entries.hint("merge").join(own, "digest", "left_anti")
        self._append(entries.withColumn("batch", F.lit(batch_id)))

    def _append(self, entries: DataFrame, name: str | None = None) -> None:
        name = name or self.name
        writer = (
            entries.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .mode("append")
        )
        create = self.path and not self.spark.catalog.tableExists(name)
        (writer.option("path", self.path) if create else writer).saveAsTable(name)


def _ranges(rows: DataFrame, steps: int) -> list[Column]:
    """Conditions that share out doc_ids, the largest first, null last; the same for the same rows."""
    if steps == 1:
        return [F.lit(True)]
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [] if low is None else sorted({low + (high - low) * n // steps for n in range(1, steps)}, reverse=True)
    doc, out, above = F.col("doc_id"), [], F.lit(True)
    for cut in cuts:
        out.append(above & (doc > cut))
        above = doc <= cut
    return [*out, doc.isNull() | above]


def temporary_index(spark: SparkSession) -> DigestIndex:
    """An index in the shared folder that goes with the session."""
    path = new_path(spark, "digest_index")
    drop_at_exit(spark, path)
    index = DigestIndex(spark, path.rsplit("/", 1)[1].replace("-", "_"), path)
    index.temporary = True
    return index
