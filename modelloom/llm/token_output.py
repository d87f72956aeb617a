"""Token ids as Parquet list columns: dictionary or delta encoding, chosen row groups, pages small enough for the page index.

Rows lie in ascending doc_id across and within files, so min/max statistics of doc_id and the page index find a document's
pages, and a read of doc_id and n_tokens touches no ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, lean, only, partitions, pieces, prepare, staged, text_buffers
from .tokens import SLICE, encoder


#: Pieces in a generation of a worker's memo, about 200 bytes each: texts of few common words meet theirs again after many others.
PIECES = 400_000


def write_tokens(docs: DataFrame, path: str, tokenizer: str, split: str, end_id: int, encoding: str = "dictionary", row_group: int = 32 << 20, page: int = 64 << 10) -> None:
    """Writes (part, doc_id, start_in_part, n_tokens, ids) of every row of `docs` (doc_id, text, ...), ids with `end_id` at the end.

    Null and empty texts are just `end_id`. Null doc_ids come first, rows that repeat one side by side. Other columns are
    ignored. encoding is "dictionary" or "delta" (DELTA_BINARY_PACKED in version 2 pages).
    """
    spark = docs.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, at, part = encoder(tokenizer, split, PIECES), 0, TaskContext.get().partitionId()
        for batch in batches:
            for i, j in pieces(text_buffers(batch.column(1))[0], SLICE):
                rows = batch.slice(i, j - i)
                begin, ids = code.encode(rows.column(1))
                ends = begin + np.arange(len(begin))
                values = pa.array(np.insert(ids, begin[1:], end_id).view(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part, np.int32)), rows.column(0), pa.array(at + ends[:-1]), pa.array(np.diff(ends)), lists], ["part", "doc_id", "start_in_part", "n_tokens", "ids"])
                at += int(ends[-1])

    parts = partitions(docs)
    # ids that very many rows share, null above all, are split by a hash of the text
    rows = only(docs, doc_id="bigint", text="string").withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    out = rows.mapInArrow(lean(run), "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>").write
    options = {"compression": "zstd", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.enable.dictionary": str(encoding == "dictionary").lower()}
    if encoding == "delta":
        options["parquet.writer.version"] = "PARQUET_2_0"
    for k, v in options.items():
        out = out.option(k, v)
    out.parquet(path)


def read_metadata(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, if asked for, the ids. One row per file is summed up in one task."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("words"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    return rows.join(bounded(staged(bases, "bases")), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", *["ids"] * ids)


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit) of every row of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends, raw = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy().astype("<i4"))).cast("B")
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_metadata(spark, path, ids=True).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
