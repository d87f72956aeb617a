"""Substring dedup by sliding sentence spans: from every sentence on, the shortest run of k or more consecutive sentences that
has enough words is hashed and joined over all documents, and so is a run of fewer sentences that is long by itself.
Sentences covered by a repeated span that isn't its first occurrence go.

A sentence ends after a word that ends in a sentence mark, of this or another script, with or without closing quotes and
brackets after it, and at a line end. Words are compared with A-Z as a-z, white space aside. The first occurrence is the one
with the smallest (doc_id, position).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, _INVERSE, _SPACE, _power, bounded, lean, mix, numbered, pieces, prepare, staged, text_buffers, unused, word_hashes

#: What ends a sentence, and what may stand between that and the word's end.
MARKS = ".!?\u2026\u203c\u2047\u2048\u2049\u3002\uff01\uff1f\uff0e\uff61\u061f\u06d4\u0589\u0964\u0965\u1362\u1367\u104b\u17d4"
CLOSERS = "\"')]}\u00bb\u00ab\u203a\u2039\u201d\u201c\u2019\u2018\u300d\u300f\u3011\u300b\u3009\uff09*_"


def _codes(signs: str) -> list[np.ndarray]:
    """The signs' UTF-8 bytes as numbers, by length."""
    return [np.array([int.from_bytes(c.encode(), "big") for c in signs if len(c.encode()) == n], np.int64) for n in (1, 2, 3)]


_MARKS, _CLOSERS = _codes(MARKS), _codes(CLOSERS)


def _last_sign(raw: np.ndarray, start: np.ndarray, end: np.ndarray, signs: list[np.ndarray]) -> np.ndarray:
    """Bytes of the sign of `signs` that raw[start:end] ends in, 0 if in none."""
    code, found = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
    for n, of in enumerate(signs, 1):
        code += raw[np.maximum(end - n, 0)].astype(np.int64) << 8 * (n - 1)
        found[(end - start >= n) & np.isin(code, of)] = n
    return found


def _ends(raw: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the words raw[start:last + 1] end a sentence."""
    end, left = last + 1, np.flatnonzero((raw[last] >= 0x80) | np.isin(raw[last], _CLOSERS[0]))
    while len(left):
        n = _last_sign(raw, start[left], end[left], _CLOSERS)
        end[left] -= n
        left = left[n > 0]
    return _last_sign(raw, start, end, _MARKS) > 0


def sentences(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, document, number of words and hash of every sentence of the documents raw[off[i]:off[i+1]]."""
    h, doc = word_hashes(off, raw)
    m = len(h)
    if not m:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    word = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[off - off[0]] = True
    start = np.flatnonzero(word & (~np.concatenate([[False], word[:-1]]) | cut[:-1]))
    last = np.flatnonzero(word & (~np.concatenate([word[1:], [False]]) | cut[1:]))
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    new = np.ones(m, bool)
    new[1:] = (doc[1:] != doc[:-1]) | _ends(raw, start, last)[:-1] | (lines[start[1:]] > lines[last[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [m]]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * _power(_BASE, m), dtype=np.uint64)])
    return start[first], doc[first], n, mix((total[first + n] - total[first]) * _power(_INVERSE, m)[first] + n.astype(np.uint64))


def _spans(k: int, least: int, alone: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            off, raw = text_buffers(batch.column(2))
            for a, b in pieces(off):
                part = off[a : b + 1]
                _, doc, n, h = sentences(part, raw[part[0] : part[-1]])
                m = len(h)
                if not m:
                    continue
                at, words = np.arange(m), np.concatenate([[0], np.cumsum(n)])
                stop, place = np.searchsorted(doc, doc, "right"), at - np.searchsorted(doc, doc)
                total = np.concatenate([[np.uint64(0)], np.cumsum(h * _power(_BASE, m), dtype=np.uint64)])
                many = np.maximum(at + k, np.searchsorted(words, words[:-1] + least))
                few = np.searchsorted(words, words[:-1] + alone)
                for end, ok in ((many, many <= stop), (few, (few < at + k) & (few <= stop))):
                    i = np.flatnonzero(ok)
                    e = end[i]
                    span = mix((total[e] - total[i]) * _power(_INVERSE, m)[i] + (e - i).astype(np.uint64))
                    cols = [span.view(np.int64), ids[a + doc[i]], rows[a + doc[i]], place[i].astype(np.int32), (place[i] + e - i - 1).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["span", "doc_id", "row", "pos", "last"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        off, raw = text_buffers(batch.column("text"))
        for i, (starts, ends) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
            data = raw[off[i] : off[i + 1]]
            at, _, n, _ = sentences(np.array([0, len(data)]), data)
            edge = np.concatenate([[0], at[1:], [len(data)]])
            gone = np.zeros(len(at), bool)
            for a, b in zip(starts, ends, strict=True):
                gone[a : b + 1] = True
            out[0].append(len(at))
            out[1].append(int(gone.sum()))
            out[2].append(int(n[gone].sum()))
            out[3].append(b"".join(data[edge[j] : edge[j + 1]].tobytes() for j in np.flatnonzero(~gone)))
        names = ["row", "doc_id", "starts", "ends", "first_doc_ids"]
        cols = [batch.column(c) for c in names] + [pa.array(x, pa.int64()) for x in out[:3]] + [pa.array(out[3], pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(cols, [*names, "n_sentences", "n_removed", "words_removed", "kept_text"])


def repeated_passages(rows: DataFrame, k: int = 3, least: int = 15, alone: int = 50) -> DataFrame:
    """(row, first_sentence, last_sentence, first_doc_id) of every passage of `rows` (doc_id, row, text) to be removed; row tells rows apart.

    A span is, from each sentence on, the shortest run of at least k sentences and `least` words, and if fewer than k
    sentences have `alone` words, their shortest such run. Passages are unions of overlapping or adjoining removed spans.
    """
    spans = staged(rows.where("doc_id IS NOT NULL").mapInArrow(lean(_spans(k, least, alone)), "span long, doc_id long, row long, pos int, last int"), "spans")
    # combined before the shuffle: a span in a third of all documents costs a row per task
    one = F.struct("doc_id", "row", "pos")
    repeated = spans.groupBy("span").agg(F.min(one).alias("one"), F.max(one).alias("other")).where("one <> other")
    repeated = staged(repeated.select("span", F.col("one.doc_id").alias("first_doc_id"), F.col("one.row").alias("first_row"), F.col("one.pos").alias("first_pos")), "repeated")
    later = spans.drop("doc_id").join(repeated, "span").where("row <> first_row OR pos <> first_pos").groupBy("row", "pos").agg(F.max("last").alias("last"), F.min("first_doc_id").alias("first_doc_id"))
    order = Window.partitionBy("row").orderBy("pos")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("new", F.coalesce((F.col("pos") > before + 1).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order))
    return runs.groupBy("row", "run").agg(F.min("pos").alias("first_sentence"), F.max("last").alias("last_sentence"), F.min("first_doc_id").alias("first_doc_id")).drop("run")


_CUT = "row long, doc_id long, starts array<int>, ends array<int>, first_doc_ids array<long>, n_sentences long, n_removed long, words_removed long, kept_text string"


def _removed(docs: DataFrame, k: int, least: int, alone: int) -> DataFrame:
    """As remove_repeats, of `docs` (doc_id, row, text), with row."""
    found = repeated_passages(docs, k, least, alone).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first_sentence", "last_sentence", "first_doc_id"))).alias("p"))
    found = staged(found.select("row", F.col("p.first_sentence").alias("starts"), F.col("p.last_sentence").alias("ends"), F.col("p.first_doc_id").alias("first_doc_ids")), "passages")
    return docs.join(bounded(found), "row").select("row", "doc_id", "text", "starts", "ends", "first_doc_ids").mapInArrow(lean(_cut), _CUT)


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    prepare(docs.sparkSession)
    number = unused("row_of_docs", docs.columns)
    return numbered(docs, number), number


def _narrow(rows: DataFrame, number: str) -> DataFrame:
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(number).alias("row"), F.col("text").cast("string").alias("text"))


def remove_repeats(docs: DataFrame, k: int = 3, least: int = 15, alone: int = 50) -> DataFrame:
    """A row for every row of `docs` (doc_id, text, ...) that loses sentences: doc_id, starts, ends (sentence numbers of its
    passages), first_doc_ids (where each came first), n_sentences, n_removed, words_removed and kept_text. Others have no row;
    `deduplicated` gives those too.

    Rows that repeat an id are rows by themselves; of equal spans the one with the smallest id, then the first row of the
    table, stays. Null ids take no part and lose nothing; null and empty texts and texts without a span lose nothing. Texts of
    any length are read whole, as one value of a row. Other columns are ignored; an empty table gives an empty result.
    """
    rows, number = _rows(docs)
    return _removed(_narrow(rows, number), k, least, alone).drop("row")


def deduplicated(docs: DataFrame, k: int = 3, least: int = 15, alone: int = 50) -> DataFrame:
    """All rows of `docs` with their columns, repeated passages cut from their texts."""
    rows, number = _rows(docs)
    cut = _removed(_narrow(rows, number), k, least, alone)
    cut = staged(cut.select(F.col("row").alias(number), F.col("kept_text").alias(unused("kept_text", docs.columns))), "kept")
    kept = cut.columns[1]
    return rows.join(cut, number, "left").select(*(F.coalesce(kept, "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
