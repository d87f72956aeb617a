"""Language ID by nearest centroids of normalised TF-IDF character n-grams, several clustered centroids per language.

Fitting uses a bounded sample of labelled rows: those whose hash falls under a bound set from the labels' counts, about
PER_LANGUAGE of each language and TOTAL in all. Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, only, pieces, prepare, text_buffers

PER_LANGUAGE, TOTAL = 400, 4000
FEATURES = 1 << 13
CENTROIDS = 4
#: Classes of length, texts that a class needs for a bound of its own, and robust standard deviations that texts may stray.
SIZES, FEW, SPREAD = 24, 20, 5.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.frombuffer("".join("x" if chr(i).isalpha() else " " for i in range(0x110000)).encode(), np.uint8) == ord("x")


def ngram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of letters (case folded), words set off by spaces: one row of FEATURES per text."""
    lower = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    letter = _letters()[codes]
    c = np.where(letter, codes + 1, 0)
    total = np.zeros(len(texts) * FEATURES, np.int64)
    one = c * 0x9E3779B1
    two = one[:-1] * 31 + c[1:] * 0x85EBCA77
    three = two[:-1] * 37 + c[2:] * 0xC2B2AE3D
    for n, h in ((1, one), (2, two), (3, three)):
        m = len(c) - n + 1
        ok = letter[:m].copy() if n == 1 else (doc[:m] == doc[n - 1 :]) & (letter[:m] | letter[1 : m + 1])
        if n == 3:
            ok &= letter[1 : m + 1]
        h = (h[:m] + n * 0x27D4EB2F) & 0x7FFFFFFFFFFFFFFF
        slot = ((h ^ (h >> 29)) * 0x165667B19E3779F9 >> 40) & (FEATURES - 1)
        total += np.bincount((doc[:m] * FEATURES + slot)[ok], minlength=len(total))
    return total.reshape(len(texts), FEATURES)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each whole text's n-gram counts in at most 6 bytes a feature; texts without a letter are left out."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = ngram_counts([batch.column("text")[i].as_py() or ""])[0]
            at = np.flatnonzero(row)
            if len(at):
                cols = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([at.astype(np.int16).tobytes()], pa.binary()), pa.array([row[at].astype(np.float32).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "doc_id", "slots", "counts"])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        out = np.empty(counts.shape, np.float32)
        for i in range(0, len(counts), 64):  # a few rows at a time need little beside the result
            x = np.log1p(counts[i : i + 64].astype(np.float32)) * self.idf
            out[i : i + 64] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return out

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the language's number, the cosine with its nearest centroid, and its lead over other languages."""
        cos = self.vectors(counts) @ self.centroids.T
        by = np.stack([cos[:, self.of == i].max(axis=1) for i in range(len(self.languages))], axis=1)
        best = by.argmax(axis=1)
        top = by.max(axis=1)
        by[np.arange(len(by)), best] = -1.0
        return best, top, top - by.max(axis=1)


    def near(self, counts: np.ndarray, best: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Whether the cosines `top` with centroids of the languages `best` reach the bound for texts of that length."""
        return top >= self.least[best, _size(counts)]


def _size(counts: np.ndarray) -> np.ndarray:
    """The class of a text's length: the logarithm of its number of n-grams, to base 2."""
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int), SIZES - 1)


def _shorter(counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A text of each row's n-grams with about a fourth of them; none is left without any."""
    some = rng.binomial(counts.astype(np.int64), 0.25).astype(np.float32)
    return np.where(some.any(axis=1, keepdims=True), some, counts)


def _bounds(model: Model, counts: np.ndarray, x: np.ndarray, lang: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The least cosine for each language and class of length, from cosines of the sample with centroids that did not see it.

    Every text stands by itself and in shorter ones drawn from it. A class's bound is its median less SPREAD robust standard
    deviations (its median distance from the median, scaled; a tenth of the median at least): the few odd texts of a sample don't move it. A class with few
    texts takes the bound of the next longer one that has enough, else of the next shorter, else half the median of all.
    """
    of_language: list[tuple[list, list]] = [([], []) for _ in model.languages]
    for i, (found, sizes) in enumerate(of_language):
        mine = np.flatnonzero(lang == i)
        for f in (0, 1) if len(mine) > 1 else (0,):
            seen = mine[1 - f :: 2] if len(mine) > 1 else mine
            c = _clusters(x[seen], CENTROIDS, rng)
            # a few rows at a time: dense arrays of the whole sample would fill the driver
            for at in np.array_split(mine[f::2], -(-len(mine[f::2]) // 32)):
                texts = counts[at]
                for _ in range(3):
                    found.append((model.vectors(texts) @ c.T).max(axis=1))
                    sizes.append(_size(texts))
                    texts = _shorter(texts, rng)
    out = np.full((len(model.languages), SIZES), np.nan)
    for i in range(len(model.languages)):
        mine, size = (np.concatenate(v) for v in of_language[i])
        for z in range(SIZES):
            y = mine[size == z]
            if len(y) >= FEW:
                middle = float(np.median(y))
                out[i, z] = max(middle / 4, middle - SPREAD * max(1.4826 * float(np.median(np.abs(y - middle))), middle / 10))
        have = np.flatnonzero(~np.isnan(out[i]))
        for z in np.flatnonzero(np.isnan(out[i])):
            longer, shorter = have[have > z], have[have < z]
            out[i, z] = out[i, longer[0]] * 2.0 ** -(longer[0] - z) if len(longer) else out[i, shorter[-1]] if len(shorter) else np.median(mine) / 2
    return out


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means, ten rounds."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(10):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> Model | None:
    """A model from `labelled` (doc_id, text, lang); None without a labelled text that has a letter.

    Rows are drawn by a hash of id and text, so rows that share an id are drawn apart; rows that share both count once."""
    rows = only(labelled, doc_id="bigint", text="string", lang="string").where("lang IS NOT NULL").withColumn("of_text", F.xxhash64("text"))
    place = F.xxhash64("doc_id", "of_text", F.lit(6)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    counts = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).collect()}
    if not counts:
        return None
    want = max(1, min(per_language, total // len(counts)))
    # rows under a bound of their hash: no order over all rows; about `want` a language, its first row by hash at least
    share = F.create_map(*(F.lit(x) for lang, r in counts.items() for x in (lang, max(r["first"], min(1.0, want / r["n"])))))
    draw = place <= share[F.col("lang")]
    drawn = rows.where(draw).dropDuplicates(["lang", "doc_id", "of_text"]).select("lang", "doc_id", "text").mapInArrow(_sparse, "lang string, doc_id long, slots binary, counts binary")
    sample = sorted(((r["lang"], r["doc_id"], r["slots"], r["counts"]) for r in drawn.collect()), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2], r[3]))
    if not sample:
        return None
    counted = np.zeros((len(sample), FEATURES), np.float32)
    for row, (_, _, slots, n) in zip(counted, sample, strict=True):
        row[np.frombuffer(slots, np.int16)] = np.frombuffer(n, np.float32)
    idf = np.log((1 + len(sample)) / (1 + (counted > 0).sum(axis=0))).astype(np.float32) + 1.0
    languages = sorted({r[0] for r in sample})
    model = Model(languages, idf, np.zeros((0, FEATURES), np.float32), np.zeros(0, int), np.zeros((0, SIZES)))
    x, lang = model.vectors(counted), np.array([languages.index(r[0]) for r in sample])
    rng = np.random.Generator(np.random.PCG64(6))
    found = [_clusters(x[lang == i], CENTROIDS, rng) for i in range(len(languages))]
    model.centroids, model.of = np.concatenate(found).astype(np.float32), np.repeat(np.arange(len(languages)), [len(c) for c in found])
    model.least = _bounds(model, counted, x, lang, rng)
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (0..1), cosine and rejected for every row of `docs` (doc_id, text, ...).

    lang_pred is a learned language, or `und` for null and empty texts, texts without a letter and where there is no model
    (score 0). score is the cosine's lead over the other languages as a share of the cosine, 0.5 at none. rejected: `und`,
    or farther from its language's centroids than texts of about that length are (`_bounds`). Null and repeated ids are rows like others; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            off, _ = text_buffers(batch.column(1))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, end in pieces(off):
                for a in range(first, end, 64):
                    e = min(a + 64, end)
                    counts = ngram_counts(texts[a:e])
                    has = counts.any(axis=1)
                    if m is None:
                        has[:] = False
                        best, top, lead = np.zeros(e - a, int), np.zeros(e - a), np.zeros(e - a)
                    else:
                        best, top, lead = m.nearest(counts)
                    score = np.where(has, np.clip(0.5 + 0.5 * np.maximum(lead, 0) / np.maximum(top, 1e-12), 0.0, 1.0), 0.0)
                    cols = [pa.array([m.languages[i] if ok else "und" for i, ok in zip(best, has, strict=True)], pa.string()), pa.array(score.astype(np.float64)), pa.array(np.where(has, top, 0.0).astype(np.float64)), pa.array(~has | ~m.near(counts, best, top) if m is not None else ~has)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, e - a), *cols], ["doc_id", "lang_pred", "score", "cosine", "rejected"])

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double, cosine double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs` (its columns as they are) whose text `identify` would not reject; where there is no model, those with a letter."""
    spark = docs.sparkSession
    prepare(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, end in pieces(text_buffers(batch.column(at))[0]):
                for i in range(first, end, 64):
                    part = batch.slice(i, min(64, end - i))
                    counts = ngram_counts([t or "" for t in part.column(at).to_pylist()])
                    keep = counts.any(axis=1) & (m.near(counts, *m.nearest(counts)[:2]) if m is not None else True)
                    yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
