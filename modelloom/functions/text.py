"""Text functions over expressions and statements, as native columns: no Python in the workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One alternation that covers every character; unrolled, since Java recurses once per character in (?:A|B)*.
DAX_TOKENS = r'//[^\n]*|--[^\n]*|/\*[\s\S]*?(?:\*/|\z)|"[^"]*(?:""[^"]*)*"?|[^"\-/]+|[\s\S]'
SQL_TOKENS = r"--[^\n]*|/\*[\s\S]*?(?:\*/|\z)|'[^']*(?:''[^']*)*'?|[^'\-/]+|[\s\S]"


def _mask(text: Column, tokens: str, noise: str) -> Column:
    """Blanks the tokens that begin with `noise`; a text in which that stands nowhere is cut into no tokens."""
    parts = F.regexp_extract_all(text, F.lit(tokens), F.lit(0))
    blanked = F.array_join(F.transform(parts, lambda t: F.when(t.rlike(f"^{noise}"), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)), "")
    return F.when(text.rlike(noise), blanked).otherwise(text)


def mask_dax(text: Column) -> Column:
    """Comments and string contents blanked, offsets and line ends kept."""
    return _mask(text, DAX_TOKENS, r'(?://|--|/\*|")')


def mask_sql(text: Column) -> Column:
    return _mask(text, SQL_TOKENS, r"(?:--|/\*|')")


#: Names in single quotes, which toggle and know no escape, and what stands between them.
NAME_TOKENS = r"'[^']*'?|[^']+"


def blank_names(masked: Column) -> Column:
    """A masked expression whose quoted names are blanked too: what calls, nesting and divisions are looked for in."""
    return _mask(masked, NAME_TOKENS, "'")


def count_calls(bare: Column, name: str) -> Column:
    return F.regexp_count(bare, F.lit(rf"(?i)(?<![A-Za-z0-9_]){name}\s*\(")).cast("bigint")


def divides(bare: Column) -> Column:
    """A division sign that is no comment's."""
    return bare.rlike(r"(?<![/*])/(?![/*])")


def referenced_measures(masked: Column) -> Column:
    """Names in brackets that no table goes before, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(masked, F.lit(r"(?<![A-Za-z0-9_'\]])\[([^\]\r\n]+)\]"), F.lit(1)))


def referenced_columns(masked: Column) -> Column:
    """array<struct<tbl, name>> of the columns named after their table, each once, in order.

    A bare name is tried at its first sign only, and a reference that stands there often is cut into its parts once."""
    found = F.array_distinct(F.regexp_extract_all(masked, F.lit(r"(?:'[^']+'|(?<![A-Za-z0-9_])[A-Za-z0-9_]++)\[[^\]\r\n]+\]"), F.lit(0)))
    part = lambda x, group: F.regexp_extract(x, r"^(?:'([^']+)'|([A-Za-z0-9_]+))\[(.*)\]$", group)
    return F.array_distinct(F.transform(found, lambda x: F.struct(F.concat(part(x, 1), part(x, 2)).alias("tbl"), part(x, 3).alias("name"))))


#: Functions that need a date table.
TIME_FUNCTIONS = ["SAMEPERIODLASTYEAR", "DATEADD", "DATESYTD", "DATESQTD", "DATESMTD", "TOTALYTD", "TOTALQTD", "TOTALMTD", "PARALLELPERIOD", "PREVIOUSMONTH", "PREVIOUSQUARTER", "PREVIOUSYEAR", "NEXTMONTH", "NEXTQUARTER", "NEXTYEAR", "DATESBETWEEN", "DATESINPERIOD"]


def time_functions(bare: Column) -> Column:
    """Those of TIME_FUNCTIONS that are called, in that order: all calls are looked for once, and their names compared."""
    called = F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z]++)\s*\("), F.lit(1))
    return F.array_intersect(F.array(*map(F.lit, TIME_FUNCTIONS)), F.transform(called, lambda x: F.upper(x)))


def table_mentions(masked: Column) -> Column:
    """Every name that may be a table's, as often as it stands there: quoted names, and bare ones that no call follows and no VAR declares."""
    tokens = F.regexp_extract_all(masked, F.lit(r"'[^']*(?:'|\z)|[A-Za-z_][A-Za-z0-9_]*+(?:\s*\()?"), F.lit(0))
    var = r"(?i)(?<![A-Za-z0-9_])VAR\s+([A-Za-z_][A-Za-z0-9_]*)"
    own = F.regexp_extract_all(masked, F.lit(var), F.lit(1))
    named = F.filter(tokens, lambda t: ~t.startswith("'") & ~t.endswith("("))
    # declared names are looked for again at each token, so only in texts that declare any
    bare = F.when(masked.rlike(var), F.filter(named, lambda t: ~F.array_contains(own, t))).otherwise(named)
    quoted = F.transform(F.filter(tokens, lambda t: t.rlike(r"^'[^']*'$")), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))
    return F.concat(bare, quoted)


def squeezed(text: Column) -> Column:
    """Each run of white space as one space, none at the ends: expressions that differ in layout only become equal."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: The SQL dialect that a connector speaks; any other is generic.
DIALECTS = {"Sql.Database": "sqlserver", "Sql.Databases": "sqlserver", "PostgreSQL.Database": "postgres", "Snowflake.Databases": "snowflake", "GoogleBigQuery.Database": "bigquery", "Oracle.Database": "oracle", "MySQL.Database": "mysql", "AmazonRedshift.Database": "redshift"}


def dialect(connector: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in DIALECTS.items() for x in kv))[connector], F.lit("generic"))


def quoted_identifier(name: Column, spoken: Column) -> Column:
    """As the dialect writes it; plain names stay bare."""
    return (
        F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), name)
        .when(spoken == "sqlserver", F.concat(F.lit("["), name, F.lit("]")))
        .when(spoken == "mysql", F.concat(F.lit("`"), name, F.lit("`")))
        .otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    )


def line_count(text: Column) -> Column:
    return F.size(F.split(text, r"\r?\n", -1)).cast("bigint")


def nesting(bare: Column, name: str) -> Column:
    """How deep calls of `name` (at most four spaces before the parenthesis) stand within each other: a fold over calls and
    parentheses that keeps open ones in an array, where the text has such a call at all."""
    call = rf"(?i)(?<![A-Za-z0-9_]){name}\s{{0,4}}\("
    parts = F.regexp_extract_all(bare, F.lit(rf"{call}|[()]"), F.lit(0))
    start = F.struct(F.array().cast("array<boolean>").alias("open"), F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, t: Column) -> Column:
        is_call = F.length(t) > 1
        closed = F.struct(
            F.when(F.size(s["open"]) > 0, F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"]).alias("open"),
            (s["now"] - F.when((F.size(s["open"]) > 0) & F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit(False)), 1).otherwise(0)).alias("now"),
            s["most"].alias("most"),
        )
        now = s["now"] + F.when(is_call, 1).otherwise(0)
        opened = F.struct(F.concat(s["open"], F.array(is_call)).alias("open"), now.alias("now"), F.greatest(s["most"], now).alias("most"))
        return F.when(t == ")", closed).otherwise(opened)

    return F.when(~bare.rlike(call), F.lit(0).cast("bigint")).otherwise(F.aggregate(parts, start, step, lambda s: s["most"].cast("bigint")))
