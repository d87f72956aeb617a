"""How far the sources of a language differ in their words: dense tiles of groups by terms, compared all pairs at once.

1. Each task counts terms and documents by (lang, source) in a table of bounded size; the counts are summed by term, and a
   language keeps the terms of enough of its documents.
2. The kept terms of a language are dealt into blocks by hash, its sources into parts. A tile holds one block for two parts:
   a row for each source, a column for each term, zeros included. So a task never holds more than one tile of bounded size,
   however many words or sources a language has and however many rows one source has.
3. In a tile numpy turns counts into rates, in whole numbers, and compares all pairs of rows by broadcasting; it also takes
   each source's most excessive terms. Partial pair matrices are summed and partial lists merged by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, lean, partitions, prepare, staged

#: A term needs so many documents of its language; so many of its terms are told for each source.
LEAST_DOCS, TOP = 3, 200
#: About so many terms and sources make a block and a part: a tile has about 2 * PART * BLOCK cells of 8 bytes.
BLOCK, PART = 1024, 64
#: Cells that one step of a comparison may have.
STEP = 1 << 19
#: Rates are told in units of 1 / 1000 ** THOUSANDS.
THOUSANDS = 3
#: A task gives its counts away when it holds so many entries, or has read so many bytes for them.
ENTRIES, BYTES = 200_000, 48 << 20

#: Bytes that belong to no term become spaces, A-Z become a-z; all bytes of other scripts stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ONE_DOC = 1 << 40


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) as this task has seen them, some terms more than once."""
    seen: dict[tuple[str, str], dict[bytes, int]] = {}
    read = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in seen.items():
            values = np.fromiter(terms.values(), np.int64, len(terms))
            told = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*told, pa.array(terms.keys(), pa.binary()).cast(pa.string()), pa.array(values & (_ONE_DOC - 1)), pa.array(values >> 40)], ["lang", "source", "term", "n", "docs"])
        seen.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            terms = seen.setdefault((lang, source), {})
            buffer = text.as_buffer()
            read += buffer.size
            for term, n in Counter(buffer.to_pybytes().translate(_FOLD).split()).items():
                terms[term] = terms.get(term, 0) + n + _ONE_DOC
        if read > BYTES or sum(map(len, seen.values())) > ENTRIES:
            yield from given()
            read = 0
    yield from given()


def rates(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 1) / total), exactly: long division by three digits at a time, for totals below 2 ** 53."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(THOUSANDS):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def compared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all rows p of `a` and q of `b` the sums over terms of floor((p - q)^2 / q), and of floor((p - q)^2 / p)."""
    by_b, by_a = np.zeros((len(a), len(b)), np.int64), np.zeros((len(a), len(b)), np.int64)
    width = max(1, STEP // max(1, len(a) * len(b)))
    for i in range(0, a.shape[1], width):
        p, q = a[:, None, i : i + width], b[None, :, i : i + width]
        square = (p - q) ** 2
        by_b += (square // q).sum(-1)
        by_a += (square // p).sum(-1)
    return by_b, by_a


_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _tile(top: int):
    """One tile: rows of sources (term null; n and of_lang are totals, held the terms of the block) and of counts. Gives partial pair sums, and each
    source's first `top` terms of this block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lang = table.column("lang")[0].as_py()
        head = pc.is_null(table.column("term"))
        heads, cells = table.filter(head), table.filter(pc.invert(head))
        order = pc.sort_indices(heads.column("source").cast(pa.binary()))
        heads = heads.take(order)
        names = heads.column("source").combine_chunks()
        part = heads.column("part").to_numpy()
        one, other = heads.column("x")[0].as_py(), heads.column("y")[0].as_py()
        # UTF-8 order is the order of bytes
        terms = pc.unique(cells.column("term")).cast(pa.binary())
        terms = terms.take(pc.sort_indices(terms))
        row = pc.index_in(cells.column("source"), names).to_numpy()
        column = pc.index_in(cells.column("term").cast(pa.binary()), terms).to_numpy()
        counts = np.zeros((len(names), len(terms)), np.int64)
        counts[row, column] = cells.column("n").to_numpy()
        p = rates(counts, heads.column("n").to_numpy()[:, None]) if len(terms) else counts
        rows: list[pa.Table] = []

        def told(kind: str, sources: np.ndarray, items: pa.Array, values: np.ndarray) -> None:
            columns = [pa.array([lang] * len(values), pa.string()), names.take(pa.array(sources)), pa.array([kind] * len(values), pa.string()), items.cast(pa.string()), pa.array(values)]
            rows.append(pa.Table.from_arrays(columns, schema=_OUT))

        first, second = np.flatnonzero(part == one), np.flatnonzero(part == other)
        # terms of this block that none of the tile's sources has are one column, counted as often as they are
        absent = heads.column("held")[0].as_py() - len(terms)
        none = rates(np.zeros((len(names), 1), np.int64), heads.column("n").to_numpy()[:, None]) if absent else p[:, :0]
        by_second, by_first = (x + absent * y for x, y in zip(compared(p[first], p[second]), compared(none[first], none[second]), strict=True))
        for of, beside, sums in ((first, second, by_second), (second, first, by_first.T))[: 1 + (one != other)]:
            a, b = (x.reshape(-1) for x in np.meshgrid(of, beside, indexing="ij"))
            apart = a != b
            told("pair", a[apart], names.take(pa.array(b[apart])), sums.reshape(-1)[apart])
        if one == other and len(terms):
            of_lang = np.zeros(len(terms), np.int64)
            of_lang[column] = cells.column("of_lang").to_numpy()
            q = rates(of_lang, heads.column("of_lang").to_numpy()[:1])
            excess = (p - q) ** 2 // q
            for i in first.tolist():
                more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                more = more[np.lexsort((more, -excess[i, more]))[:top]]
                told("term", np.full(len(more), i), terms.take(pa.array(more)), excess[i, more])
        return pa.concat_tables(rows)

    return run


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of `docs` (text, lang, source, ...).

    Null text, lang and source count as ''. Terms are runs of ASCII letters and signs beyond ASCII, A-Z lower-cased; a language
    keeps those of `least_docs` or more of its documents. The rate of a kept term in a group is
    p = 1 + floor(10^9 (count + 1) / (N + V)), with N the group's kept words and V the language's kept terms.

    part 'pair': a row for each other source of the language, value = the sum of floor((p - q)^2 / q) over all kept terms, q being
    the other's rate; 0 where a language keeps none. part 'term': the `top` terms whose rate is above that of the language (q).
    rank counts from 1 by value, greatest first, then by the item's UTF-8. Groups without a term have rows too, a group
    alone in its language and without terms has none. Repeated rows count as often as given; other columns are ignored; an empty
    table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = docs.mapInArrow(lean(_counted), "lang string, source string, term string, n long, docs long")
    # one shuffle: what is dealt by lang and term is also together by lang, source and term
    counted = counted.repartition(partitions(docs), "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    cells = counted.withColumns({"of_lang": F.sum("n").over(of_term), "docs": F.sum("docs").over(of_term), "is_first": F.col("source") == F.min("source").over(of_term)})
    cells = staged(cells.where(F.col("docs") >= least_docs).drop("docs"), "cells")

    groups = docs.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n"))
    groups = groups.unionByName(cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = staged(groups, "groups")
    sizes = groups.groupBy("lang").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("sources"))
    terms = cells.groupBy("lang").agg(F.count_if("is_first").alias("terms"))
    langs = sizes.join(terms, "lang", "left").fillna(0, ["terms"])
    langs = bounded(staged(langs.select("lang", "words", "terms", F.expr(f"greatest(1, ceil(terms / {BLOCK}))").cast("int").alias("blocks"), F.expr(f"greatest(1, ceil(sources / {PART}))").cast("int").alias("parts")), "langs"))

    placed = {"part": F.expr("CAST(pmod(xxhash64(source), parts) AS INT)"), "beside": F.explode(F.expr("sequence(0, parts - 1)"))}
    tiles = {"x": F.least("part", "beside"), "y": F.greatest("part", "beside")}
    counts = cells.join(langs, "lang").withColumn("block", F.expr("CAST(pmod(xxhash64(term), blocks) AS INT)")).withColumns(placed).withColumns(tiles)
    held = counts.where("is_first AND beside = part").groupBy("lang", "block").agg(F.count(F.lit(1)).alias("held"))
    heads = groups.join(langs, "lang").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).join(bounded(staged(held, "held")), ["lang", "block"], "left").withColumns(placed).withColumns(tiles)
    heads = heads.select("lang", "block", "x", "y", "part", "source", F.lit(None).cast("string").alias("term"), F.expr("n + terms").alias("n"), F.expr("words + terms").alias("of_lang"), F.coalesce("held", F.lit(0)).alias("held"))
    counts = counts.withColumn("held", F.lit(None).cast("long")).select(*heads.columns)
    found = counts.union(heads).groupBy("lang", "block", "x", "y").applyInArrow(_tile(top), "lang string, source string, part string, item string, value long")
    found = staged(found, "tiles")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
