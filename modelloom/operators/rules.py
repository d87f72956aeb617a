"""Rule catalogues: every rule is a predicate over one frame of the catalogue, and its hits share a schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str | Callable[[], Column]
    test: Callable[[], Column]

    def level(self) -> Column:
        return F.lit(self.severity) if isinstance(self.severity, str) else self.severity()


def _length() -> Column:
    """In UTF-16 units, as the thresholds count."""
    return F.octet_length(F.encode("expression", "UTF-16LE")) / 2


_bare = lambda: F.col("bare")
QA = [
    Rule("DAX-DIVISION", "DAX", "high", lambda: text.divides(_bare())),
    Rule("DAX-NESTED-IF", "DAX", "medium", lambda: text.nesting(_bare(), "IF") >= 4),
    Rule("DAX-IF-CHAIN", "DAX", "medium", lambda: (text.count_calls(_bare(), "IF") >= 5) & (text.count_calls(_bare(), "SWITCH") == 0)),
    Rule("DAX-NESTED-CALCULATE", "DAX", "medium", lambda: text.nesting(_bare(), "CALCULATE") >= 3),
    Rule("DAX-COMPLEX-MEASURE", "DAX", "medium", lambda: (_length() > 900) | (text.line_count(F.col("expression")) > 25)),
    Rule("DAX-NO-FORMAT", "DAX", "low", lambda: F.col("format_string").isNull() & ~F.col("is_hidden")),
]

_sql = lambda pattern: F.col("masked").rlike(f"(?i){pattern}")
_raw = lambda pattern: F.col("statement").rlike(pattern)


def orders_for_limit(masked: Column) -> Column:
    """Whether rows are limited or numbered, so that their order matters."""
    return masked.rlike(r"(?i)\bTOP\s*\(?\s*\d") | masked.rlike(r"(?i)\b(?:LIMIT|OFFSET)\b") | masked.rlike(r"(?i)\bFETCH\s+(?:FIRST|NEXT)") | masked.rlike(r"(?i)\bROW_NUMBER\s*\(")


_limited = lambda: orders_for_limit(F.col("masked"))
_spoken = lambda: text.dialect(F.col("connector"))
#: Functions that keep a filtered column from its index, and sources that bill by what is scanned.
FUNCTIONS = ["UPPER", "LOWER", "LTRIM", "RTRIM", "TRIM", "CONVERT", "CAST", "SUBSTRING", "LEFT", "RIGHT", "ISNULL", "COALESCE", "DATEPART", "MONTH", "DAY"]
BILLED_BY_SCAN = ["bigquery", "snowflake", "redshift"]
#: A call of one of them, closed, and then a comparison.
COMPARED = rf"\b(?:{'|'.join(FUNCTIONS)})\s*\([^)]*\)\s*(?:=|<|>|!=|(?:LIKE|IN)\b)"
LIST_HEAD = r"\bSELECT\s+(?:(?:DISTINCT|TOP\s*\(?\s*\d+\s*\)?)\s+)*"
YEAR = r"\bYEAR\s*\(\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\)\s*=\s*(\d{4})\b"


def _sorted() -> Column:
    """The masked text from the first ORDER BY on; empty without one."""
    return F.regexp_extract("masked", r"(?is)\bORDER\s+BY\b.*", 0)


SQL = [
    Rule("SQL-SELECT-STAR", "SQL", lambda: F.when(_spoken().isin(BILLED_BY_SCAN), "high").otherwise("medium"), lambda: _sql(LIST_HEAD + r"\*")),
    Rule("SQL-ORDER-BY", "SQL", "medium", lambda: (_sorted() != "") & ~_sorted().contains(")") & ~_limited()),
    Rule("SQL-NON-SARGABLE-YEAR", "SQL", "high", lambda: _sql(YEAR)),
    Rule("SQL-NON-SARGABLE-FUNCTION", "SQL", "medium", lambda: _sql(COMPARED)),
    Rule("SQL-LEADING-WILDCARD", "SQL", "medium", lambda: _raw(r"(?i)\bLIKE\s*'%") & _sql(r"\bLIKE\b")),
    Rule("SQL-REDUNDANT-DISTINCT", "SQL", "medium", lambda: _sql(r"\bSELECT\s+DISTINCT\b") & _sql(r"\bGROUP\s+BY\b")),
    Rule("SQL-NO-FILTER", "SQL", "medium", lambda: _sql(r"\bFROM\b") & ~_sql(r"\bWHERE\b") & ~_limited()),
    Rule("SQL-IMPLICIT-CONVERSION", "SQL", "medium", lambda: _raw(r"\b[A-Za-z_][A-Za-z0-9_.]*\s*=\s*'\d+'")),
    Rule("SQL-CORRELATED-SUBQUERY", "SQL", "medium", lambda: _sql(r"\b(?:EXISTS|IN)\s*\(\s*SELECT\b")),
    Rule("SQL-MANY-JOINS", "SQL", "low", lambda: F.regexp_count("masked", F.lit(r"(?i)\bJOIN\b")) >= 5),
    Rule("SQL-NOLOCK", "SQL", "medium", lambda: _sql(r"\bNOLOCK\b") & (_spoken() == "sqlserver")),
    Rule("SQL-NESTED-SELECT-STAR", "SQL", "medium", lambda: _sql(r"\(\s*SELECT\s+\*")),
]


def _replaced(before: str, what: str, by: Column) -> Column:
    """The statement with `what`, where it first stands behind `before` in the masked text, replaced: both texts have the same offsets, so
    comments and strings neither match nor change."""
    at = F.length(F.regexp_extract("masked", rf"(?i)^(?s:.*?){before}(?={what})", 0))
    size = F.length(F.regexp_extract(F.substring("masked", at + 1, F.length("masked")), rf"(?i)^{what}", 0))
    return F.concat(F.substring("statement", F.lit(1), at), by, F.substring("statement", at + size + 1, F.length("statement")))


def _star_listed() -> Column:
    """The star as the loaded columns, if it is the only one and they are known."""
    names = F.array_join(F.transform("loaded", lambda c: text.quoted_identifier(c, _spoken())), ", ")
    stars = F.regexp_count("masked", F.lit(r"(?<![A-Za-z0-9_.])\*(?![A-Za-z0-9_])"))
    return F.when((stars == 1) & (F.size("loaded") > 0), _replaced(LIST_HEAD, r"\*", names))


def _year_range() -> Column:
    column, year = (F.regexp_extract("masked", f"(?i){YEAR}", i) for i in (1, 2))
    return _replaced("", YEAR, F.concat(column, F.lit(" >= '"), year, F.lit("-01-01' AND "), column, F.lit(" < '"), (year.cast("int") + 1).cast("string"), F.lit("-01-01'")))


REWRITES = {
    "SQL-SELECT-STAR": ("high", _star_listed),
    "SQL-ORDER-BY": ("high", lambda: F.regexp_replace(F.substring("statement", F.lit(1), F.length("masked") - F.length(_sorted())), r"\s+\z", "")),
    "SQL-NON-SARGABLE-YEAR": ("medium", _year_range),
    "SQL-REDUNDANT-DISTINCT": ("high", lambda: _replaced(r"\bSELECT\s+", r"DISTINCT\s+", F.lit(""))),
}


def sql_rewrites(rows: DataFrame, key: str) -> DataFrame:
    """(target, rule_id, confidence, suggested) of every statement for which a rule has a rewrite.

    `rows` has statement, masked, connector and loaded (array of the columns that its table loads)."""
    rules = [r for r in SQL if r.id in REWRITES]
    offers = F.array_compact(F.array(*(F.when(r.test(), F.struct(F.lit(r.id).alias("rule_id"), F.lit(REWRITES[r.id][0]).alias("confidence"), REWRITES[r.id][1]().alias("suggested"))) for r in rules)))
    return rows.select(F.col(key).alias("target"), F.explode(offers).alias("o")).select("target", "o.*").where("suggested IS NOT NULL")


def findings(rows: DataFrame, rules: list[Rule], name: str) -> DataFrame:
    """(rule_id, category, severity, target) of all rules in one pass over `rows`: no union of scans, no shuffle."""
    hits = F.array_compact(F.array(*(F.when(r.test(), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), r.level().alias("severity"))) for r in rules)))
    return rows.select(F.col(name).alias("target"), F.explode(hits).alias("hit")).select("hit.*", "target")
