"""What the service keeps beside the corpus: immutable generations of the catalogue, and every revision that was ever published.

A generation is a folder of its own, with the catalogue's fields and no text; cursors name it, so that a page is never of another
state of the corpus. Generations older than the newest few are removed. Revisions and their blocks are appended, never changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import InvalidArgument
from ..operators.segments import split

KEEP = 2


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Snapshots:
    """Generations and revisions under one folder, which the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _table(self, name: str) -> DataFrame | None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.parquet(f"{self.root}/{name}") if there else None

    def generations(self) -> list[int]:
        """Numbers of the generations that can be read, in order."""
        log = self._table("log")
        every = [] if log is None else sorted(r["snapshot_id"] for r in log.collect())  # one row for each
        return every[-KEEP:]

    def publish(self, entries: DataFrame, texts: DataFrame) -> int:
        """A new generation of entries, and the revisions (document_id, revision_id, text) that are not kept yet. It counts once its row of
        the log is written; then the oldest beyond KEEP goes."""
        log = self._table("log")
        every = [] if log is None else sorted(r["snapshot_id"] for r in log.collect())
        number = (every[-1] if every else 0) + 1
        entries.repartition("document_id").sortWithinPartitions("document_id").write.mode("overwrite").parquet(f"{self.root}/snapshot-{number}")
        kept = self._table("revisions")
        new = texts if kept is None else texts.join(kept.select("document_id", "revision_id"), ["document_id", "revision_id"], "left_anti")
        blocks = split(new).withColumn("block_id", F.concat("revision_id", F.lit(":"), "ordinal"))
        blocks.repartition("document_id").sortWithinPartitions("document_id", "ordinal").write.mode("append").option("parquet.bloom.filter.enabled#document_id", "true").option("parquet.block.size", 8 << 20).parquet(f"{self.root}/blocks")
        new.drop("text").write.mode("append").parquet(f"{self.root}/revisions")
        self.spark.createDataFrame([(number,)], "snapshot_id int").coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        for old in every[: -KEEP + 1] if KEEP > 1 else every:
            remove(self.spark, f"{self.root}/snapshot-{old}")
        return number

    def catalogue(self, number: int, known: list[int] | None = None) -> DataFrame:
        """Entries of a generation; known: those that can be read, if the caller has just asked."""
        if number not in (self.generations() if known is None else known):
            raise InvalidArgument("CURSOR_EXPIRED")
        return self.spark.read.parquet(f"{self.root}/snapshot-{number}")

    def revision(self, document_id: str, revision_id: str) -> dict:
        """The row of a revision, current or old; another one is never put in its place."""
        kept = self._table("revisions")
        found = [] if kept is None else kept.where((F.col("document_id") == document_id) & (F.col("revision_id") == revision_id)).limit(1).collect()
        if not found:
            raise InvalidArgument("REVISION_UNAVAILABLE")
        return found[0].asDict(recursive=True)

    def blocks(self, document_id: str, revision_id: str) -> DataFrame:
        """Blocks of a revision; row groups of other documents are not read."""
        own = (F.col("document_id") == document_id) & (F.col("revision_id") == revision_id)
        # An interrupted publication may have left blocks that are written again: each ordinal once.
        return self.spark.read.parquet(f"{self.root}/blocks").where(own).dropDuplicates(["ordinal"])
