"""Toxicity by maximum-scoring segments of token log-odds.

Training: a token is a word and its first four and five letters; it scores the log-odds of toxic against clean texts, both
smoothed by a Dirichlet prior in proportion to the token's overall count. Tokens well above chance (z over Z) make the
model; a word scores the best of its tokens, any other word the small negative log-odds of a word outside the model.
Near copies in training count once, by one min-hash of three-word shingles.

Scoring: one linear scan finds all maximal scoring segments (Ruzzo and Tompa). As scores are log-likelihood ratios, chance
segments follow an extreme-value law with lambda 1: E(S) = K m exp(-S) segments of score S or more in a text of m words,
K fitted on clean training texts. Segments with E under SIGNIFICANT are toxic passages. A text's evidence is the sum of
-log E over them; a logistic curve fitted in training turns it into 0..1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, only, prepare, shingle_sets, staged, text_buffers

#: The classifier is fitted on about so many labelled rows.
SAMPLE = 20_000
PRIOR, Z, SIGNIFICANT = 50.0, 4.0, 0.05
EDGE = ".,;:!?\"'()[]{}<>*#$%&-_/\\|~`^+=«»“”‘’…"
MEMO = 500_000


def tokens_of(chunk: str) -> list[str]:
    w = chunk.strip(EDGE).lower()
    if not w:
        return []
    return [f"w{w}"] + [f"{n}{w[:n]}" for n in (4, 5) if len(w) >= n]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) in one pass.

    Each holds the place of the last one before it with a smaller sum before, so the walks back are linear in all."""
    found: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum at the end, place of the last with less before
    total = 0.0
    for i, s in enumerate(scores):
        if s > 0:
            first, left, right = i, total, total + s
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= left:
                    j = found[j][4]
                if j < 0 or found[j][3] >= right:
                    break
                first, left = found[j][0], found[j][2]
                del found[j:]
            found.append((first, i + 1, left, right, j))
        total += s
    return [(a, b, r - left) for a, b, left, r, _ in found]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.01
    k: float = 1e-3
    slope: float = 1.0
    shift: float = -3.0
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, chunk: str) -> float:
        have = self.memo.get(chunk)
        if have is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            have = self.memo[chunk] = max((self.scores[t] for t in tokens_of(chunk) if t in self.scores), default=self.other)
        return have

    def passages(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's evidence and its significant passages (first word, last + 1, score). Words are split at white space."""
        words = text.split()
        found = []
        scores = list(map(self.memo.get, words))
        if None in scores:
            scores = list(map(self.word, words))
        if scores and max(scores) > 0:
            bound = math.log(max(self.k * len(words), 1e-300))
            found = [(a, b, s) for a, b, s in segments(scores) if bound - s < math.log(SIGNIFICANT)]
            return sum(s - bound for _, _, s in found), found
        return 0.0, found

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.shift + self.slope * math.log1p(max(0.0, evidence))))))


def _min_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = [int(mix(s).min().view(np.int64)) if len(s) else 0 for s in shingle_sets(*text_buffers(batch.column("text")), 3)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(low, pa.int64())], ["doc_id", "toxic", "low"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each token, toxic and clean, summed over a partition."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({t for chunk in set((text or "").split()) for t in tokens_of(chunk)})
    every = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(every), 50_000):
        part = every[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([counts[1][t] for t in part], pa.int64()), pa.array([counts[0][t] for t in part], pa.int64())], ["token", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the texts of `docs` (doc_id, text) that `labels` (doc_id, toxic 0/1) marks; of several labels the largest holds.

    About `sample` labelled rows are used, drawn by a hash of doc_id; of texts that share an id the first by its hash. Without a toxic and a clean text the model finds nothing.
    """
    spark = docs.sparkSession
    prepare(spark)
    marked = only(labels, doc_id="bigint", toxic="int").where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = staged(marked, "marked")
    share = min(1.0, sample / max(1, marked.count()))
    drawn = marked.where(F.xxhash64("doc_id", F.lit(4)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52) < share)
    # about `sample` rows of two numbers: bounded, so it may be broadcast
    texts = staged(only(docs, doc_id="bigint", text="string").join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text"), "labelled")
    one = texts.mapInArrow(_min_hashes, "doc_id long, toxic int, low long").groupBy("low", "toxic").agg(F.min("doc_id").alias("doc_id"))
    texts = staged(texts.join(F.broadcast(one.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("toxic", "text"), F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "t.*"), "training")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model()
    if len(sizes) < 2:
        return model
    n1, n0 = sizes[1], sizes[0]
    counted = texts.mapInArrow(_count, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("y"), F.sum("clean").alias("x"))
    # Dirichlet prior: PRIOR pseudo-texts spread as the token is over both classes
    rate = (F.col("x") + F.col("y")) / float(n0 + n1)
    a = rate * PRIOR
    odds = lambda c, n: F.log((F.col(c) + a) / (F.lit(float(n)) + PRIOR - F.col(c) - a))
    delta = odds("y", n1) - odds("x", n0)
    scored = counted.where(f"y > 2 AND y * {n0} > x * {n1}").withColumn("delta", delta).withColumn("z", delta / F.sqrt(1.0 / (F.col("y") + a) + 1.0 / (F.col("x") + a)))
    raw = (F.log((F.col("y") + 0.5) / (F.lit(float(n1)) + 1.0)) - F.log((F.col("x") + 0.5) / (F.lit(float(n0)) + 1.0)))
    kept = scored.where(F.col("z") > Z).select("token", F.least("delta", raw).alias("score")).collect()  # of a bounded sample of texts
    model.scores = {r["token"]: float(r["score"]) for r in kept if r["score"] > 0}
    scan = _evidence(model, texts)
    total = scan.agg(F.sum(F.expr("if(toxic = 1, words, 0)")).alias("w1"), F.sum(F.expr("if(toxic = 0, words, 0)")).alias("w0"), F.sum(F.expr("if(toxic = 1, hits, 0)")).alias("h1"), F.sum(F.expr("if(toxic = 0, hits, 0)")).alias("h0")).first()
    out1, out0 = ((total[f"w{i}"] - total[f"h{i}"] + 1.0) / (total[f"w{i}"] + 2.0) for i in (1, 0))
    model.other = min(math.log(out1 / out0), -1e-3)
    # K from the share of clean texts that reach the smallest model score by chance
    least = min(model.scores.values(), default=1.0)
    rows = _evidence(model, texts).select("toxic", "words", "top").collect()
    clean = [r for r in rows if r["toxic"] == 0 and r["words"]]
    reached = (sum(r["top"] >= least for r in clean) + 0.5) / (len(clean) + 1.0)
    model.k = min(1.0, -math.log(1.0 - min(reached, 0.999)) * math.exp(least) / max(1.0, float(np.mean([r["words"] for r in clean] or [1]))))
    rows = _evidence(model, texts).select("toxic", "evidence").collect()
    x, y = np.log1p(np.array([r["evidence"] for r in rows])), np.array([r["toxic"] for r in rows], float)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    b, c = 0.0, 1.0
    for _ in range(50):  # Newton steps on the ridge-penalised likelihood, classes weighing alike
        p = 1.0 / (1.0 + np.exp(-np.clip(b + c * x, -30, 30)))
        g = np.array([(weight * (y - p)).sum(), (weight * (y - p) * x).sum() - c])
        v = weight * p * (1 - p) + 1e-9
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1.0]])
        step = np.linalg.solve(h, g)
        b, c = b + step[0], c + step[1]
    model.shift, model.slope = float(b), max(0.0, float(c))
    return model


def _evidence(model: Model, texts: DataFrame) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = (text or "").split()
                scores = list(map(m.word, words))
                evidence, _ = m.passages(text or "")
                rows.append((len(words), sum(s > 0 for s in scores), max((s for _, _, s in segments(scores)), default=0.0), evidence))
            w, h, t, e = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(w, pa.int64()), pa.array(h, pa.int64()), pa.array(t, pa.float64()), pa.array(e, pa.float64())], ["toxic", "words", "hits", "top", "evidence"])

    return texts.select("toxic", "text").mapInArrow(run, "toxic int, words long, hits long, top double, evidence double")


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0..1), predicted (score >= threshold), evidence and passages (words first..last of each toxic passage) of
    every row of `docs` (doc_id, text, ...).

    Null and empty texts have no evidence and the score of that. Whole texts are scanned, however long. Null and repeated
    ids are rows like others; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.passages(t or "") for t in batch.column(1).to_pylist()]
            p = [m.score(e) for e, _ in found]
            rows = [[{"first": a, "last": b - 1, "score": s} for a, b, s in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array([e for e, _ in found], pa.float64()), pa.array(rows, passage)], ["doc_id", "score", "predicted", "evidence", "passages"])

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id long, score double, predicted int, evidence double, passages array<struct<first:int,last:int,score:double>>")
