"""Exact dedup against a persistent index of text digests, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, bounded, new_path, only, partitions, prepare, staged


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


class DigestIndex:
    """Rows (digest, first_id) in a Parquet table bucketed and sorted by digest.

    The folder outlives the session: the number of buckets is kept beside it, so opened again it is the same index. As
    both sides are hashed alike, looking a batch up shuffles the batch only, never the index. `buckets` counts for a new
    index: choose it for the digests that it will hold in the end.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32):
        self.spark = spark
        self.path = path or new_path(spark, "digests")
        spark.createDataFrame([(buckets,)], "buckets int").write.mode("ignore").parquet(f"{self.path}-buckets")
        self.buckets = buckets = spark.read.parquet(f"{self.path}-buckets").first()["buckets"]
        self.name = f"digests_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, first_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Adds the groups (digest, min_id) that the index lacks, by a sort-merge anti-join."""
        fresh = groups.hint("merge").join(self.rows(), "digest", "left_anti").select("digest", F.col("min_id").alias("first_id"))
        staged(fresh, "fresh").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)


def dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of `docs` (doc_id, text, ...), new texts going to `index`.

    Texts are equal if identical after each white-space run becomes a space; null is the empty text. keep_id is the id the
    index holds for the text: the smallest of the batch that brought it. group_size counts the rows of this batch. Rows
    with a null doc_id are kept only if no row of that text has an id (keep_id is null then). Rows that repeat an id and
    a text are one document and share their `kept`. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    index = index or DigestIndex(spark, buckets=max(32, partitions(docs)))
    docs = only(docs, doc_id="bigint", text="string")
    digests = staged(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "digests")
    found = staged(digests.groupBy("digest").agg(F.min("doc_id").alias("min_id"), F.count(F.lit(1)).alias("n")), "found")
    index.append(found)
    known = found.hint("merge").join(index.rows(), "digest").where("n > 1 OR NOT first_id <=> min_id")
    known = bounded(staged(known.select("digest", F.lit(True).alias("known"), F.col("first_id").alias("keep_id"), F.col("n").alias("group_size")), "known"))
    out = digests.join(known, "digest", "left")
    keep = F.when(F.col("known"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
