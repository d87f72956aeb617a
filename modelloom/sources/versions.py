"""Versions of project files kept in a bucketed table: told by their content, a later save of the same content replaces the earlier one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: so many versions are kept.
KEEP = 25


def content_hashes(parts: DataFrame) -> DataFrame:
    """(file, sha256) of `parts` (file, part, bytes): of the digests of its parts by name, so the order they are stored in doesn't matter.

    A file's parts are few; only their digests are brought together. Bytes that are null count as none."""
    digest = F.sha2(F.coalesce("bytes", F.lit(b"")), 256)
    told = F.transform(F.array_sort(F.collect_list(F.struct("part", digest.alias("digest")))), lambda x: F.concat_ws(":", x["part"], x["digest"]))
    return parts.groupBy("file").agg(F.sha2(F.array_join(told, "\n"), 256).alias("sha256"))


class VersionStore:
    """A table (sha256, created, name, batch), bucketed and sorted by sha256. Batches are appended and never rewritten, so a batch that
    fails leaves the store as it was; what is current is told when it is read, bucket by bucket, without a shuffle."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 16):
        self.spark, self.table, self.buckets = spark, table, buckets

    def save(self, versions: DataFrame, batch: int) -> None:
        """Appends `versions` (sha256, created, name); of one content in a batch the newest counts. Rows that the store has already just
        as they are are left out, by a merge of sorted buckets."""
        newest = versions.groupBy("sha256").agg(F.max_by(F.struct("created", "name"), F.struct("created", "name")).alias("v")).select("sha256", "v.created", "v.name")
        if self.spark.catalog.tableExists(self.table):
            same = ["sha256", "created", "name"]
            newest = newest.join(self.current().select(*same).hint("merge"), same, "left_anti")
        newest.withColumn("batch", F.lit(batch)).write.bucketBy(self.buckets, "sha256").sortBy("sha256").mode("append").saveAsTable(self.table)

    def current(self) -> DataFrame:
        """(sha256, created, name): each content as the last batch that had it told it."""
        rows = self.spark.table(self.table)
        return rows.groupBy("sha256").agg(F.max_by(F.struct("created", "name"), "batch").alias("v")).select("sha256", "v.created", "v.name")

    def kept(self, keep: int = KEEP) -> DataFrame:
        """The `keep` newest, kept as a heap per task."""
        return self.current().orderBy(F.desc("created"), "sha256").limit(keep)
