"""A trigram index over texts: which trigrams every match of a regular expression must hold, and which rows hold them.

`trigram_query` reads a pattern's parse tree and gives an OR of ANDs of trigrams, in lower case, that holds for every text with a
match; a pattern without mandatory trigrams gives ANY. Postings are bitmaps of 32,768 rows each, so no posting list grows
with the table; they are intersected and united by bitmap aggregates. Everything that touches rows is native.
"""

from __future__ import annotations

from itertools import product
from re import _constants as kind
from re import _parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Strings that a part of a pattern may stand for before it is told by trigrams; alternatives that a query may have.
STRINGS, BRANCHES = 64, 64


def _fold(c: int) -> str:
    return chr(c + 32) if 65 <= c <= 90 else chr(c)


def _either(*queries: Query) -> Query:
    """One of the queries holds; a branch that asks for more than another one says nothing new."""
    all_of = frozenset().union(*queries)
    least = frozenset(q for q in all_of if not any(o < q for o in all_of))
    return least if len(least) <= BRANCHES else ANY


def _both(a: Query, b: Query) -> Query:
    joined = _either(frozenset(x | y for x, y in product(a, b)))
    # too many branches: the narrower of the two is still mandatory
    return joined if joined != ANY or ANY in (a, b) else min(a, b, key=len)


def _of(strings: frozenset[str]) -> Query:
    """One of the strings stands in the text."""
    return _either(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)) if strings else ANY


class _Part:
    """What a part of a pattern matches: all strings if they are few (`exact`), else how matches begin and end; and a query."""

    def __init__(self, exact: frozenset[str] | None, first: frozenset[str] = frozenset([""]), last: frozenset[str] = frozenset([""]), query: Query = ANY):
        if exact is not None and len(exact) > STRINGS:
            first, last, query, exact = exact, exact, _both(query, _of(exact)), None
        if exact is None:
            # what begins and ends matches is told by trigrams; two signs are kept for the trigrams of seams
            query = _both(_both(query, _of(first)), _of(last))
            first, last = frozenset(s[:2] for s in first), frozenset(s[-2:] for s in last)
        self.exact, self.first, self.last, self.query = exact, first if exact is None else exact, last if exact is None else exact, query

    def then(self, other: _Part) -> _Part:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= STRINGS:
            return _Part(frozenset(a + b for a, b in product(self.exact, other.exact)))
        seam = _of(frozenset(a + b for a, b in product(self.last, other.first)))
        first = frozenset(a + b for a, b in product(self.exact, other.first)) if self.exact is not None else self.first
        last = frozenset(a + b for a, b in product(self.last, other.exact)) if other.exact is not None else other.last
        return _Part(None, first, last, _both(_both(self.query, other.query), seam))

    def told(self) -> Query:
        return self.query if self.exact is None else _both(self.query, _of(self.exact))


def _or(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts):
        return _Part(frozenset().union(*(p.exact for p in parts)))
    return _Part(None, frozenset().union(*(p.first for p in parts)), frozenset().union(*(p.last for p in parts)), _either(*(p.told() for p in parts)))


_EMPTY = _Part(frozenset([""]))
_SIGN = _Part(None)


def _class(items: list) -> _Part:
    signs: set[str] = set()
    for op, value in items:
        if op is kind.LITERAL:
            signs.add(_fold(value))
        elif op is kind.RANGE and value[1] - value[0] < STRINGS:
            signs |= {_fold(c) for c in range(value[0], value[1] + 1)}
        else:
            return _SIGN
    return _Part(frozenset(signs)) if len(signs) <= 8 else _SIGN


def _read(tree) -> _Part:
    whole = _EMPTY
    for op, value in tree:
        if op is kind.LITERAL:
            part = _Part(frozenset([_fold(value)]))
        elif op is kind.IN:
            part = _class(value)
        elif op is kind.SUBPATTERN:
            part = _read(value[-1])
        elif op is kind.BRANCH:
            part = _or([_read(x) for x in value[1]])
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
            least, most, body = value
            one = _read(body)
            part = _EMPTY
            for _ in range(min(least, 8)):
                part = part.then(one)
            if most == 1 and least == 0:
                part = _or([_EMPTY, one])
            elif most != least or least > 8:
                part = part.then(_SIGN)
        elif op is kind.AT:
            part = _EMPTY
        else:
            part = _SIGN
        whole = whole.then(part)
    return whole


def trigram_query(pattern: str) -> Query:
    """Every text with a match of `pattern`, lower-cased, holds all trigrams of one of these sets; ANY if nothing is mandatory."""
    return _read(parser.parse(pattern)).told()


# --- the index ------------------------------------------------------------------


def placed(docs: DataFrame) -> DataFrame:
    """doc_id and text of `docs` with the place of each row: `file` (a 64-bit hash of its path) and `row` (its number there). Frames
    that aren't read from Parquet files are staged first. Nothing is collected."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) if not _is_read(docs) else docs
    if not _is_read(docs):
        docs = staged(docs, "rows")
    at = docs.metadataColumn("_metadata")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row"))


def _is_read(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed().toString().strip()
    return plan.startswith("Relation [") and plan.endswith("] parquet")


def postings(rows: DataFrame, trigrams: list[str] | None = None) -> DataFrame:
    """(trigram, file, bucket, bitmap) of `rows` (text, file, row): the rows of each 32,768 whose lower-cased text holds the trigram.

    With `trigrams` only these are indexed, by a search for each; without, every trigram of every text."""
    text = F.lower("text")
    if trigrams is None:
        held = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))"), F.lit(1)))
    else:
        held = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(t)), F.lit(t)) for t in trigrams)))
        rows = rows.withColumn("text", text)
    at = rows.select(F.explode(held).alias("trigram"), "file", F.expr("row + 1").alias("place"))
    return at.groupBy("trigram", "file", F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))


#: The numbers of the bits that are set, from byte to byte.
_BITS = """flatten(transform(filter(sequence(0, octet_length(bitmap) - 1), i -> substring(bitmap, i + 1, 1) <> X'00'),
    i -> transform(filter(sequence(0, 7), b -> shiftright(CAST(conv(hex(substring(bitmap, i + 1, 1)), 16, 10) AS INT), b) % 2 = 1), b -> i * 8 + b)))"""


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(file, row, kinds): the rows of `index` (postings) that may match, for each name of `queries` (none of which is ANY).

    Postings of a branch are intersected, branches united: bitmaps of fixed size, in groups of one bucket and query."""
    wanted = [(name, i, t, len(branch)) for name, query in queries.items() for i, branch in enumerate(sorted(query, key=sorted)) for t in sorted(branch)]
    # a row for each trigram of the queries, so the side is broadcast
    terms = F.broadcast(index.sparkSession.createDataFrame(wanted, "name string, branch int, trigram string, needed int"))
    met = index.join(terms, "trigram").groupBy("name", "branch", "needed", "file", "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("held")).where("held = needed")
    found = met.groupBy("name", "file", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    bits = found.select("name", "file", "bucket", F.explode(F.expr(_BITS)).alias("bit"))
    return bits.groupBy("file", F.expr("(bucket - 1) * 32768 + bit").alias("row")).agg(F.collect_set("name").alias("kinds"))
