import random
import re
import time

import pytest
from pyspark.sql import functions as F

from modelloom.functions import text
from modelloom.operators.rules import SQL, findings, sql_rewrites
from modelloom.operators.scoring import category_scores


def _one(spark, s, f):
    return spark.createDataFrame([(s,)], "e string").select(f(F.col("e"))).first()[0]


def _bare(c):
    return text.blank_names(text.mask_dax(c))


def test_masks_keep_length_and_blank_noise(spark):
    dax = 'a // x / y\n"q "" / r" + 1 /* / */ -- /'
    out = _one(spark, dax, text.mask_dax)
    assert len(out) == len(dax) and "/" not in out and "\n" in out
    sql = "select '--x''*' -- *\nfrom t /* * */"
    out = _one(spark, sql, text.mask_sql)
    assert len(out) == len(sql) and "*" not in out and "from t" in out
    names = "SUM ( 'Sales/Returns'[Amt] ) + 'IF (x)'[a] + 'open\n ("
    out = _one(spark, names, _bare)
    assert len(out) == len(names) and "/" not in out and "IF" not in out and "\n" in out and out.rstrip().endswith("+")


def test_nesting_and_calls(spark):
    e = "IF ( a, IF ( b, SUM ( c ), IF ( d, 1, 2 ) ), IF ( x, 1, 2 ) )"
    assert _one(spark, e, lambda c: text.nesting(c, "IF")) == 3
    assert _one(spark, e, lambda c: text.count_calls(c, "IF")) == 4
    assert _one(spark, "", lambda c: text.nesting(c, "IF")) == 0
    assert _one(spark, "IF( 'IF ('[a], IF     ( 1 ) )", lambda c: text.nesting(_bare(c), "IF")) == 1  # more than four spaces
    assert _one(spark, ") IF ( IF ( 1 ) ) SUMIF ( 2 )", lambda c: text.nesting(c, "IF")) == 2
    assert [_one(spark, e, lambda c: text.divides(_bare(c))) for e in ("a / b", "'x/y'[c]", "a // b", "a /* b */ c", "a /", '"a/b"')] == [True, False, False, False, True, False]


def test_references(spark):
    assert _one(spark, "[A] + T[B] + 'T'[C] + [A] - [D] + [no\nname]", text.referenced_measures) == ["A", "D"]
    assert [tuple(x) for x in _one(spark, "T[B] + 'T 1'[C] + [A] + T[B]", text.referenced_columns)] == [("T", "B"), ("T 1", "C")]
    assert _one(spark, "totalytd ( 1 ) + DATEADD(2) -- NEXTYEAR (", lambda c: text.time_functions(_bare(c))) == ["DATEADD", "TOTALYTD"]


def test_references_of_random_texts(spark):
    dice = random.Random(7)
    texts = ["".join(dice.choices("[]'aB_1 \n(", k=dice.randrange(30))) for _ in range(400)] + [f"{x} {y} (" for x in ("DATEADD", "xDATEADD", "dateadd2", "_") for y in ("datesYTD", "T[c]")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, e string").select("i", text.referenced_measures(F.col("e")).alias("m"), text.referenced_columns(F.col("e")).alias("c"), text.time_functions(F.col("e")).alias("t")).orderBy("i").collect()
    for e, r in zip(texts, rows, strict=True):
        assert r["m"] == list(dict.fromkeys(x[1] for x in re.findall(r"(^|[^A-Za-z0-9_'\]])\[([^\]\r\n]+)\]", e))), e
        columns = [re.match(r"^(?:'([^']+)'|([A-Za-z0-9_]+))\[(.*)\]$", x) for x in re.findall(r"(?:'[^']+'|[A-Za-z0-9_]+)\[[^\]\r\n]+\]", e)]
        # a name in quotes may hold a line end, brackets stay on one line
        assert [tuple(x) for x in r["c"]] == list(dict.fromkeys(((m[1] or "") + (m[2] or ""), m[3]) for m in columns)), e
        called = {x.upper() for x in re.findall(rf"(?i)(?<![A-Za-z0-9_])({'|'.join(text.TIME_FUNCTIONS)})\s*\(", e)}
        assert r["t"] == [x for x in text.TIME_FUNCTIONS if x in called], e


def test_long_texts_take_no_time_by_the_square(spark):
    began = time.monotonic()
    assert _one(spark, "A" * 400_000 + " T[c]", text.referenced_columns) == [("T", "c")]
    assert _one(spark, "(" * 120_000, lambda c: text.nesting(c, "IF")) == 0
    assert time.monotonic() - began < 20


def test_table_mentions(spark):
    found = _one(spark, "VAR Orders = 1 RETURN Orders + COUNTROWS ( Sales ) + SUM ( 'My T'[Amt] ) + Sales ( 2 ) + 'odd Sales", lambda c: text.table_mentions(text.mask_dax(c)))
    assert found.count("Sales") == 1 and found.count("My T") == 1 and "Orders" not in found and "SUM" not in found


def test_score_of_half_the_objects_with_a_high_finding(spark):
    hits = spark.createDataFrame([("DAX", "high", str(i)) for i in range(5)] + [("DAX", "low", "0")], "category string, severity string, target string")
    pops = spark.createDataFrame([("DAX", 10), ("Model", 0)], "category string, population long")
    assert {r["category"]: r["score"] for r in category_scores(hits, pops).collect()} == {"DAX": 70, "Model": None}


CASES = [
    ("SELECT * FROM t WHERE a = 1", "Sql.Database", {"SQL-SELECT-STAR"}),
    ("SELECT TOP (10) * FROM t ORDER BY a", "Sql.Database", {"SQL-SELECT-STAR"}),
    ("SELECT a, top FROM t", "X", {"SQL-NO-FILTER"}),
    ("SELECT a FROM t WHERE b > 1 ORDER BY a", "X", {"SQL-ORDER-BY"}),
    ("SELECT a FROM t WHERE b > 1 ORDER BY a FETCH FIRST 5 ROWS ONLY", "X", set()),
    ("SELECT a, (SELECT b FROM c ORDER BY 1) FROM t WHERE b > 1 ORDER BY a", "X", set()),
    ("SELECT a FROM t WHERE YEAR(d) = 2024", "X", {"SQL-NON-SARGABLE-YEAR"}),
    ("SELECT a FROM t WHERE YEAR(f(d)) = 2024 OR YEAR(d) = 20245", "X", set()),
    ("SELECT a FROM t WHERE lower(b)='x' AND UPPER(c) LIKE 'y'", "X", {"SQL-NON-SARGABLE-FUNCTION"}),
    ("SELECT a FROM t WHERE b LIKE'%x'", "X", {"SQL-LEADING-WILDCARD"}),
    ("SELECT count(DISTINCT a) FROM t WHERE a > 1 GROUP BY b", "X", set()),
    ("SELECT DISTINCT a FROM t WHERE a > 1 GROUP BY a", "X", {"SQL-REDUNDANT-DISTINCT"}),
    ("SELECT a FROM t WHERE t.code='42' OR [x] = '7'", "X", {"SQL-IMPLICIT-CONVERSION"}),
    ("SELECT a FROM t WITH (NOLOCK) WHERE a > 1", "Sql.Databases", {"SQL-NOLOCK"}),
    ("SELECT a FROM t WITH (NOLOCK) WHERE a > 1", "MySQL.Database", set()),
    ("SELECT a FROM t -- WHERE x LIKE '%a'", "X", {"SQL-NO-FILTER"}),
]


@pytest.fixture(scope="module")
def cases(spark):
    rows = spark.createDataFrame([(str(i), s, c, ["Id", "Net Amount"]) for i, (s, c, _) in enumerate(CASES)], "key string, statement string, connector string, loaded array<string>")
    return rows.withColumn("masked", text.mask_sql(F.col("statement")))


def test_statement_rules(cases):
    got = {}
    for r in findings(cases, SQL, "key").collect():
        got.setdefault(int(r["target"]), set()).add(r["rule_id"])
    assert got == {i: want for i, (_, _, want) in enumerate(CASES) if want}


def test_star_costs_more_where_scans_are_billed(spark):
    rows = spark.createDataFrame([("1", "SELECT * FROM t WHERE a = 1", "GoogleBigQuery.Database")], "key string, statement string, connector string")
    assert findings(rows.withColumn("masked", F.col("statement")), SQL, "key").first()["severity"] == "high"


def test_statement_rewrites(cases):
    got = {(int(r["target"]), r["rule_id"]): r["suggested"] for r in sql_rewrites(cases, "key").collect()}
    assert got == {
        (0, "SQL-SELECT-STAR"): "SELECT Id, [Net Amount] FROM t WHERE a = 1",
        (1, "SQL-SELECT-STAR"): "SELECT TOP (10) Id, [Net Amount] FROM t ORDER BY a",
        (3, "SQL-ORDER-BY"): "SELECT a FROM t WHERE b > 1",
        (6, "SQL-NON-SARGABLE-YEAR"): "SELECT a FROM t WHERE d >= '2024-01-01' AND d < '2025-01-01'",
        (11, "SQL-REDUNDANT-DISTINCT"): "SELECT a FROM t WHERE a > 1 GROUP BY a",
    }
