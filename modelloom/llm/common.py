"""What the operators of this folder share: the shared folder, staged tables, size checks, word and shingle hashes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
#: Rows, and bytes in files, that a side may have to be broadcast. Beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, and keeps Arrow batches small enough for very long texts."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def lean(run):
    """`run`, for mapInArrow, giving freed memory back to the system when a task ends: workers stay, and so would it."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return tidy


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where that is unset in a local session."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="modelloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: a lost executor costs no recomputation beyond here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether a staged table is within both bounds for a broadcast."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= BROADCAST_BYTES and df.count() <= BROADCAST_ROWS


def bounded(df: DataFrame) -> DataFrame:
    """Marks a staged table for broadcast if it is small enough; else the join stays a shuffle join."""
    return F.broadcast(df) if is_small(df) else df


def unused(name: str, columns: list[str]) -> str:
    """`name`, with a sign more for each column that is called so already, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a column `name` that tells its rows apart, the same at every reading: file and row number of a table read
    from Parquet files, which are not copied; other frames are staged first."""
    spark = docs.sparkSession
    plan = docs._jdf.queryExecution().analyzed().toString().strip()
    if not (plan.startswith("Relation [") and plan.endswith("] parquet")):
        docs = staged(docs, "rows")
    path, number, index = (unused(x, docs.columns) for x in ("path_of_row", "number_of_file", "index_of_row"))
    # a row a file: as many as the table has files, not rows
    files = docs.select(F.col("_metadata.file_path").alias(path)).distinct()
    files = staged(files.withColumn(number, F.row_number().over(Window.orderBy(path)).cast("long")), "files")
    rows = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
    rows = rows.join(bounded(files), path)
    return rows.select(*docs.columns, (F.shiftleft(number, 40) + F.col(index)).alias(name))


def partitions(df: DataFrame, size: int = 64 << 20) -> int:
    """Into how many parts a shuffle of all of `df` should go: one for `size` bytes of what it is read from, and at least the session's number."""
    of_session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # a plan without statistics claims the largest number there is, or the share of it that its columns make up
    return of_session if known >= 1 << 55 else max(of_session, -(-known // size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **types: str) -> DataFrame:
    """Just the named columns, cast: others, whatever their names, can't clash."""
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in types.items()))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1) and bytes of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.view(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def pieces(off: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `size` bytes each; a longer document stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# --- hashes -----------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _letters() -> np.ndarray:
    """A random 64-bit number per byte, the same for A-Z as for a-z."""
    t = np.random.Generator(np.random.PCG64(20240601)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    t[65:91] = t[97:123]
    return t


_LETTERS = _letters()


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 18), base, np.uint64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if n <= 1 << 20:  # those of a very long text aren't kept
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` (A-Z as a-z) of the documents raw[off[i]:off[i+1]], with the document of each."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    cut = np.zeros(n + 1, bool)
    cut[off - off[0]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[raw] * _power(_BASE, n), out=total[1:])
    h = (total[end] - total[start]) * _power(_INVERSE, n)[start]
    return mix(h + (end - start).astype(np.uint64)), np.searchsorted(off - off[0], start, "right") - 1


def shingle_sets(off: np.ndarray, raw: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; without words, none."""
    for a, b in pieces(off):
        part = off[a : b + 1]
        h, doc = word_hashes(part, raw[part[0] : part[-1]])
        m = len(h) - k + 1
        if m > 0:
            s = h[:m]
            for i in range(1, k):
                s = s * np.uint64(0x9FB21C651E98DF25) + h[i : m + i]
            s = mix(s)
        bounds = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if hi - lo >= k:
                x = np.sort(s[lo : hi - k + 1])
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                yield x[keep]
            elif hi > lo:
                x = hi - lo
                for w in h[lo:hi].tolist():
                    x = (x * 0xD6E8FEB86659FD93 ^ w) & 0xFFFFFFFFFFFFFFFF
                yield mix(np.array([x], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
