"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Fitting takes a bounded sample: k-means centres, and how many of the nearest centres a query must probe so that RECALL of
the sample's own neighbours lie under them (data without clusters need most of them). Every row is indexed: its unit
vector less its centre, normalised and rotated, keeps one bit per dimension and three scalars (the residual's length, its
product with the centre, and its product with its own code). A product with a query is estimated from the bits; the code's
deviation bounds the error. Per probed block only rows whose upper bound reaches the k-th lower bound are reranked with
the original vectors in double precision.

Rows meet queries in blocks (centre, row block, query block) of fixed size, so a vector in a third of all rows spreads
over many tasks, and each block gives at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, staged

SAMPLE = 20_000
ROWS_A_CENTRE, MAX_CENTRES = 2048, 1024
RECALL = 0.98
ROW_BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Deviations of the estimate that a bound allows for.
SIGMA = 3.0


@dataclass
class Index:
    centres: np.ndarray
    rotation: np.ndarray
    probes: int


def usable(rows: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, v) with v double[] of `dim` numbers (the commonest length if None), without null, zero and non-finite vectors."""
    v = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where("vec_id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")
    if dim is None:
        top = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = top["d"] if top else 0
    return v.where(F.size("v") == dim)


def fit(vectors: DataFrame, k: int) -> Index | None:
    """Centres, rotation and number of probes from about SAMPLE of the usable `vectors`, drawn by a hash of vec_id."""
    n = vectors.count()
    if not n:
        return None
    drawn = vectors.where(F.xxhash64("vec_id", F.lit(3)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52) < min(1.0, SAMPLE / n)).orderBy("vec_id").limit(2 * SAMPLE).collect()
    x = np.array([r["v"] for r in drawn] or [r["v"] for r in vectors.limit(1).collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.Generator(np.random.PCG64(3))
    m = int(np.clip(n // ROWS_A_CENTRE, 1, min(MAX_CENTRES, max(1, len(x) // 16))))
    c = x[rng.choice(len(x), m, replace=False)]
    for _ in range(10):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(m)])
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    probes = m
    if m > 1:
        near = (x @ c.T).argmax(axis=1)
        q = rng.choice(len(x), min(200, len(x)), replace=False)
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -2.0
        best = np.argsort(-s, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(x[q] @ c.T), axis=1), axis=1)
        need = np.sort(place[np.arange(len(q))[:, None], near[best]].ravel())
        probes = min(m, int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))]) + 1)
    return Index(c, rotation, probes)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled first, so that neither tiny nor huge numbers leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            u = _unit(x)
            at = (u @ index.centres.T).argmax(axis=1)
            c = index.centres[at]
            r = u - c
            length = np.sqrt((r * r).sum(axis=1))
            o = r / np.maximum(length, 1e-300)[:, None]
            z = o @ index.rotation.T
            d = x.shape[1]
            cols = [pa.array(at.astype(np.int32)), batch.column("vec_id"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([b.tobytes() for b in np.packbits(z > 0, axis=1)], pa.binary()), pa.array(length), pa.array((o * c).sum(axis=1)), pa.array(np.abs(z).sum(axis=1) / np.sqrt(d))]
            yield pa.RecordBatch.from_arrays(cols, ["centre", "vec_id", "v", "code", "length", "along", "own"])

    return run


def _probe(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            near = np.argsort(-(_unit(x) @ index.centres.T), axis=1, kind="stable")[:, : index.probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(near.tolist(), pa.list_(pa.int32()))], ["query_id", "q", "centres"])

    return run


def _search(shared, k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        index = shared.value
        out: list[tuple] = []
        if len(rows) and len(queries):
            x = np.frombuffer(b"".join(rows["v"]), np.float64).reshape(len(rows), -1)
            d = x.shape[1]
            ids = rows["vec_id"].to_numpy()
            bits = np.unpackbits(np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1), axis=1, count=d).astype(np.float32)
            length, along, own = (rows[c].to_numpy() for c in ("length", "along", "own"))
            own = np.maximum(own, 1e-9)
            spread = length * np.sqrt(np.maximum(1.0 - own * own, 0.0)) / own * SIGMA / np.sqrt(max(d - 1, 1)) + 1e-6
            unit = _unit(x)
            centre = index.centres[int(key[0])]
            every = np.frombuffer(b"".join(queries["q"]), np.float64).reshape(len(queries), -1)
            for i in range(0, len(queries), 128):
                q = _unit(every[i : i + 128])
                qid = queries["query_id"].to_numpy()[i : i + 128]
                rest = q - centre
                z = (rest @ index.rotation.T).astype(np.float32)
                code = (2.0 * (bits @ z.T) - z.sum(axis=1)) / np.sqrt(d)
                estimate = q @ centre + length[:, None] * (along[:, None] + code / own[:, None])
                error = spread[:, None] * np.linalg.norm(rest, axis=1)
                estimate[ids[:, None] == qid] = -np.inf
                low = estimate - error
                floor = np.partition(low, len(ids) - k, axis=0)[len(ids) - k] if len(ids) > k else np.full(len(qid), -np.inf)
                for j in range(len(qid)):
                    at = np.flatnonzero((estimate[:, j] + error[:, j] >= floor[j]) & (ids != qid[j]))
                    # row by row, so that equal vectors score alike
                    score = np.minimum(1.0, np.maximum(-1.0, (unit[at] * q[j]).sum(axis=1)))
                    best = np.lexsort((ids[at], -score))[:k]
                    out += [(qid[j], ids[at[b]], score[b]) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of the k nearest rows of `vectors` found for each row of `queries`.

    Both have vec_id and embedding (numbers); other columns are ignored. A query's own vec_id is no candidate. Null, zero
    and non-finite vectors, those with null components, of another length than most or with a null vec_id take no part.
    Equal scores go to the smaller vec_id; rows that repeat an id and a vector count each. With fewer than k candidates a
    query gets them all; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = staged(usable(vectors), "vectors")
    index = fit(rows, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)
    codes = staged(rows.mapInArrow(_encode(shared), "centre int, vec_id long, v binary, code binary, length double, along double, own double"), "codes")
    wanted = usable(queries, index.centres.shape[1]).mapInArrow(_probe(shared), "query_id long, q binary, centres array<int>")
    wanted = staged(wanted.select("query_id", "q", F.explode("centres").alias("centre")), "probes")
    # blocks of fixed size: a few numbers for each of at most MAX_CENTRES centres
    count = lambda df, size, name: df.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    blocks = F.broadcast(count(codes, ROW_BLOCK, "nr").join(count(wanted, QUERY_BLOCK, "nq"), "centre"))
    share = lambda c, n: F.pmod(F.xxhash64(c, F.lit(1)), F.col(n)).cast("int")
    left = codes.join(blocks, "centre").select("*", share("vec_id", "nr").alias("rb"), F.explode(F.expr("sequence(0, nq - 1)")).alias("qb"))
    right = wanted.join(blocks, "centre").select("*", share("query_id", "nq").alias("qb"), F.explode(F.expr("sequence(0, nr - 1)")).alias("rb"))
    keys = ["centre", "rb", "qb"]
    found = left.drop("nr", "nq").groupBy(*keys).cogroup(right.drop("nr", "nq").groupBy(*keys)).applyInPandas(_search(shared, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
