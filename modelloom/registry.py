"""Name -> query over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import attribution, duplicates, edits, graph, lineage, model_rules, quality, replay, search
from .operators.model_rules import Views
from .operators.rules import FUNCTIONS, QA, SQL, Rule, findings, sql_rewrites
from .operators.scoring import category_scores
from .plans.derived import duck
from .plans.stage import staged
from .sources import parts, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- frames for DuckDB ----------------------------------------------------------

_q = lambda x: x.replace("'", "''")


def _duck_mask(column: str, tokens: str, noise: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({column}, '{_q(tokens)}'), lambda t: CASE WHEN regexp_matches(t, '{_q(noise)}') THEN regexp_replace(t, '[^\\n]', ' ', 'g') ELSE t END), '')"


def _duck_nesting(name: str) -> str:
    """ord, deepest: of the calls that are open at one place the most. A call is open until the parentheses fall back to where it began."""
    return rf"""(WITH t AS (SELECT ord, unnest(x) AS tok, generate_subscripts(x, 1) AS i FROM (SELECT ord, regexp_extract_all(bare, '(?i)\b{name}\s{{0,4}}\(|[()]') AS x FROM m)),
d AS (SELECT *, sum(CASE WHEN tok = ')' THEN -1 ELSE 1 END) OVER (PARTITION BY ord ORDER BY i) AS level FROM t),
o AS (SELECT a.ord, a.i, (SELECT min(b.i) FROM d b WHERE b.ord = a.ord AND b.i > a.i AND b.level < a.level) AS closed FROM d a WHERE length(a.tok) > 1)
SELECT ord, max(n) AS deepest FROM (SELECT a.ord, a.i, count(*) AS n FROM o a JOIN o b ON b.ord = a.ord AND b.i <= a.i AND coalesce(b.closed > a.i, true) GROUP BY a.ord, a.i) GROUP BY ord)"""


_M = f"SELECT *, {_duck_mask('masked', text.NAME_TOKENS, '^' + chr(39))} AS bare FROM (SELECT *, {_duck_mask('expression', text.DAX_TOKENS, chr(94) + '(//|--|/\\*|' + chr(34) + ')')} AS masked FROM ({duck('dv_measures')}))"
_masked_statement = f"{_duck_mask('statement', text.SQL_TOKENS, chr(94) + '(--|/\\*|' + chr(39) + ')')} AS masked"
_REFS = r"SELECT DISTINCT name, unnest(regexp_extract_all(masked, '(^|[^A-Za-z0-9_\x27\]])\[([^\]\r\n]+)\]', 2)) AS ref FROM m"
#: What each name in a query's SQL stands for. Only those that it names, or that these name, go in front of it.
FRAMES = {
    "m": _M, "r": _REFS, "s": f"SELECT *, {_masked_statement} FROM ({duck('dv_statements')})", "pt": f"SELECT *, {_masked_statement} FROM ({duck('dv_partitions')})",
    **{x: duck(y) for x, y in (("v", "dv_visuals"), ("rf", "dv_refs"), ("pg", "dv_pages"), ("rel", "dv_relations"), ("tab", "dv_tables"), ("col", "dv_columns"), ("ch", "dv_changes"), ("pa", "dv_parts"))},
    **{f"{p}_{x}": duck(f"{q}_{x}") for p, q in (("of", "dv"), ("by", "dx")) for x in ("tables", "columns", "measures", "relations", "partitions", "pages", "visuals", "refs")},
    "nesting_if": _duck_nesting("IF"), "nesting_switch": _duck_nesting("SWITCH"), "nesting_calculate": _duck_nesting("CALCULATE"), "mentions": model_rules.MENTIONS_SQL,
}


def _with(sql: str) -> str:
    used, grown = sql, True
    names: list[str] = []
    while grown:
        grown = False
        for name, body in FRAMES.items():
            if name not in names and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", used):
                names.append(name)
                used, grown = used + body, True
    frames = [f"{n} AS MATERIALIZED ({FRAMES[n]})" for n in FRAMES if n in names]
    return f"WITH {', '.join(frames)} {sql}" if frames else sql


def query(sql: str | None = None):
    """Registers a function of the views, with the DuckDB SQL for its rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = _with(sql)
        return f

    return add


# --- text functions ---------------------------------------------------------------

_calls = lambda f: rf"CAST(len(regexp_extract_all(bare, '(?i)\b{f}\s*\(')) AS BIGINT)"
_QA = {
    "DAX-DIVISION": "m WHERE regexp_matches(bare, '(^|[^/*])/([^/*]|$)')",
    "DAX-NESTED-IF": "m WHERE ord IN (SELECT ord FROM nesting_if WHERE deepest >= 4)",
    "DAX-NESTED-CALCULATE": "m WHERE ord IN (SELECT ord FROM nesting_calculate WHERE deepest >= 3)",
    "DAX-IF-CHAIN": f"m WHERE {_calls('IF')} >= 5 AND {_calls('SWITCH')} = 0",
    "DAX-COMPLEX-MEASURE": r"m WHERE length(expression) > 900 OR len(regexp_split_to_array(expression, '\r?\n')) > 25",
    "DAX-NO-FORMAT": "m WHERE format_string IS NULL AND NOT is_hidden",
}
_DAX_SCORE = "CAST(least(100, greatest(0, floor(100.0::DOUBLE * (1.0::DOUBLE - affected / (population * 10.0::DOUBLE)) + 0.5))) AS BIGINT)"


@query(f"SELECT 'DAX' AS category, affected, population, {_DAX_SCORE} AS score FROM (SELECT CAST(6 * count(DISTINCT name) AS BIGINT) AS affected FROM {_QA['DAX-DIVISION']}), (SELECT count(*) AS population FROM m)")
def flagship(v: Views) -> DataFrame:
    rows = v.measures()
    return category_scores(findings(rows, [QA[0]], "name"), rows.groupBy(F.lit("DAX").alias("category")).agg(F.count(F.lit(1)).alias("population")))


@query("SELECT ord, name, masked FROM m")
def mask_dax(v):
    return v.measures().select("ord", "name", "masked")


@query("SELECT ord, bare FROM m")
def blank_names(v):
    return v.measures().select("ord", "bare")


def statements(v: Views) -> DataFrame:
    return v.get("dv_statements").withColumn("masked", text.mask_sql(F.col("statement")))


@query("SELECT ord, masked FROM s")
def mask_sql(v):
    return statements(v).select("ord", "masked")


@query(f"SELECT ord, {_calls('IF')} AS n_if, {_calls('SUM')} AS n_sum, {_calls('FILTER')} AS n_filter FROM m")
def count_calls(v):
    return v.measures().select("ord", *(text.count_calls(F.col("bare"), f).alias(f"n_{f.lower()}") for f in ("IF", "SUM", "FILTER")))


@query("SELECT m.ord, CAST(coalesce(a.deepest, 0) AS BIGINT) AS n_if, CAST(coalesce(b.deepest, 0) AS BIGINT) AS n_calculate FROM m LEFT JOIN nesting_if a ON a.ord = m.ord LEFT JOIN nesting_calculate b ON b.ord = m.ord")
def nesting(v):
    return v.measures().select("ord", text.nesting(F.col("bare"), "IF").alias("n_if"), text.nesting(F.col("bare"), "CALCULATE").alias("n_calculate"))


@query("SELECT name, ref FROM r")
def measure_refs(v):
    return v.refs().distinct()


@query(f"SELECT name, tbl, c AS col FROM {model_rules._CREFS}")
def column_refs(v):
    return v.column_refs().distinct()


@query("SELECT ord, name, tbl, n FROM mentions")
def table_mentions(v):
    return model_rules.mentions(v)


@query(rf"SELECT ord, list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(bare, '(?i)\b({'|'.join(text.TIME_FUNCTIONS)})\s*\(', 1), lambda x: upper(x)))), 'string_agg', ',') AS functions FROM m WHERE regexp_matches(bare, '(?i)\b({'|'.join(text.TIME_FUNCTIONS)})\s*\(')")
def time_functions(v):
    used = text.time_functions(F.col("bare"))
    return v.measures().where(F.size(used) > 0).select("ord", F.array_join(F.array_sort(used), ",").alias("functions"))


QUERIES["line_count"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.line_count(F.col("text")).alias("lines"))
ORACLE_SQL["line_count"] = r"SELECT doc_id, CAST(len(regexp_split_to_array(text, '\r?\n')) AS BIGINT) AS lines FROM documents"


@query("SELECT ord, trim(regexp_replace(expression, '\\s+', ' ', 'g')) AS plain FROM m")
def normalised_expressions(v):
    return v.get("dv_measures").select("ord", text.squeezed(F.col("expression")).alias("plain"))


@query("SELECT ord, CASE connector WHEN 'Sql.Database' THEN 'sqlserver' WHEN 'Sql.Databases' THEN 'sqlserver' WHEN 'PostgreSQL.Database' THEN 'postgres' WHEN 'Snowflake.Databases' THEN 'snowflake' WHEN 'GoogleBigQuery.Database' THEN 'bigquery' ELSE 'generic' END AS dialect FROM s")
def dialects(v):
    return v.get("dv_statements").select("ord", text.dialect(F.col("connector")).alias("dialect"))


# --- rules --------------------------------------------------------------------------

_has = lambda p, c="masked": f"regexp_matches({c}, '(?i){p}')"
_LIMIT = _has(r"\bTOP\s*\(?\s*\d|\bLIMIT\b|\bFETCH\s+(FIRST|NEXT)|\bOFFSET\b|\bROW_NUMBER\s*\(")
_AFTER = r"regexp_extract(masked, '(?is)\bORDER\s+BY\b.*')"
_STAR = r"\bSELECT\s+((DISTINCT|TOP\s*\(?\s*\d+\s*\)?)\s+)*\*"
_YEAR = r"\bYEAR\s*\(\s*([A-Za-z_][\w.]*)\s*\)\s*=\s*(\d{4})\b"
_COMPARED = rf"\b({'|'.join(FUNCTIONS)})\s*\([^)]*\)\s*(<>|!=|[<>]=?|=|(LIKE|IN)\b)"
_SQL = {
    "SQL-SELECT-STAR": _has(_STAR),
    "SQL-ORDER-BY": f"{_AFTER} <> '' AND NOT contains({_AFTER}, ')') AND NOT {_LIMIT}",
    "SQL-NON-SARGABLE-YEAR": _has(_YEAR),
    "SQL-NON-SARGABLE-FUNCTION": _has(_COMPARED),
    "SQL-LEADING-WILDCARD": _has(r"\bLIKE\s*''%", "statement") + " AND " + _has(r"\bLIKE\b"),
    "SQL-REDUNDANT-DISTINCT": _has(r"\bSELECT\s+DISTINCT\b") + " AND " + _has(r"\bGROUP\s+BY\b"),
    "SQL-NO-FILTER": _has(r"\bFROM\b") + " AND NOT " + _has(r"\bWHERE\b") + f" AND NOT {_LIMIT}",
    "SQL-IMPLICIT-CONVERSION": r"regexp_matches(statement, '\b[A-Za-z_][\w.]*\s*=\s*''\d+''')",
    "SQL-CORRELATED-SUBQUERY": _has(r"\b(EXISTS|IN)\s*\(\s*SELECT\b"),
    "SQL-MANY-JOINS": r"len(regexp_extract_all(masked, '(?i)\bJOIN\b')) >= 5",
    "SQL-NOLOCK": _has(r"\bNOLOCK\b") + " AND connector IN ('Sql.Database', 'Sql.Databases')",
    "SQL-NESTED-SELECT-STAR": _has(r"\(\s*SELECT\s+\*"),
}


def _named(rule: Rule) -> str:
    return f"sqlrule_{rule.id.lower()[4:].replace('-', '_')}" if rule.category == "SQL" else f"qa_{rule.id.lower().replace('-', '_')}"


def _rule(rule: Rule):
    def run(spark, sf_dir):
        v = Views(spark, sf_dir)
        return findings(statements(v).withColumn("key", F.col("ord").cast("string")), [rule], "key") if rule.category == "SQL" else findings(v.measures(), [rule], "name")

    return run


for _r in QA + SQL:
    QUERIES[_named(_r)] = _rule(_r)
    _level = f"'{_r.severity}'" if isinstance(_r.severity, str) else "CASE WHEN connector IN ('Snowflake.Databases', 'GoogleBigQuery.Database', 'AmazonRedshift.Database') THEN 'high' ELSE 'medium' END"
    ORACLE_SQL[_named(_r)] = _with(f"SELECT '{_r.id}' AS rule_id, '{_r.category}' AS category, {_level} AS severity, " + (f"CAST(ord AS VARCHAR) AS target FROM s WHERE {_SQL[_r.id]}" if _r.category == "SQL" else f"name AS target FROM {_QA[_r.id]}"))
for _name, _f in model_rules.RULES.items():
    QUERIES[_name] = (lambda f: lambda spark, sf_dir: f(Views(spark, sf_dir)))(_f)
    ORACLE_SQL[_name] = _with(model_rules.SQL[_name])

_HEAD = r"regexp_extract(masked, '(?is)^(.*?\bSELECT\s+(?:DISTINCT\s+)?(?:TOP\s*\(?\s*\d+\s*\)?\s+)?)\*', 1)"
_DISTINCT = r"regexp_extract(masked, '(?is)^(.*?\bSELECT\s+)(DISTINCT\s+)', {0})".format
_quoted_names = "CASE WHEN connector IN ('Sql.Database', 'Sql.Databases') THEN 'Id, [Net Amount]' ELSE 'Id, \"Net Amount\"' END"


@query(rf"""SELECT CAST(ord AS VARCHAR) AS target, rule_id, confidence, suggested FROM (
SELECT ord, 'SQL-SELECT-STAR' AS rule_id, 'high' AS confidence, statement[:length({_HEAD})] || {_quoted_names} || statement[length({_HEAD}) + 2:] AS suggested FROM s WHERE {_SQL['SQL-SELECT-STAR']} AND loaded <> '' AND len(regexp_extract_all(masked, '\*')) = 1
UNION ALL SELECT ord, 'SQL-ORDER-BY', 'high', rtrim(statement[:length(statement) - length({_AFTER})]) FROM s WHERE {_SQL['SQL-ORDER-BY']}
UNION ALL SELECT ord, 'SQL-NON-SARGABLE-YEAR', 'medium', regexp_replace(statement, '(?i){_YEAR}', '\1 >= ''\2-01-01'' AND \1 < ''' || CAST(CAST(regexp_extract(masked, '(?i){_YEAR}', 2) AS INT) + 1 AS VARCHAR) || '-01-01''') FROM s WHERE {_SQL['SQL-NON-SARGABLE-YEAR']}
UNION ALL SELECT ord, 'SQL-REDUNDANT-DISTINCT', 'high', statement[:length({_DISTINCT(1)})] || statement[length({_DISTINCT(1)}) + length({_DISTINCT(2)}) + 1:] FROM s WHERE {_SQL['SQL-REDUNDANT-DISTINCT']})""")
def sql_rewritten(v):
    rows = statements(v).withColumns({"key": F.col("ord").cast("string"), "loaded": F.filter(F.split("loaded", ","), lambda x: x != "")})
    return sql_rewrites(rows, "key")


# --- joins over the model -------------------------------------------------------------


@query(f"SELECT name, ref FROM {model_rules.MISSING_SQL}")
def missing_dependency(v):
    return model_rules.missing_dependencies(v).distinct()


@query("SELECT name, CAST(count(DISTINCT by_name) AS BIGINT) AS callers FROM (SELECT name AS by_name, unnest(regexp_extract_all(expression, '\\[([^\\]\\r\\n]+)\\]', 1)) AS name FROM m) WHERE by_name <> name AND name IN (SELECT name FROM m) GROUP BY name")
def callers_index(v):
    return attribution.callers(v)


@query("SELECT name FROM m WHERE name NOT IN (SELECT field FROM rf WHERE kind = 'measure') AND name NOT IN (SELECT ref FROM r WHERE name <> ref)")
def unused_measures(v):
    return model_rules.unused_measures(v).select("name")


@query("SELECT name FROM m WHERE name NOT IN (SELECT field FROM rf WHERE kind = 'measure')")
def measures_not_on_page(v):
    return v.get("dv_measures").select("name").join(v.get("dv_refs").where("kind = 'measure'").select(F.col("field").alias("name")), "name", "left_anti")


@query(f"SELECT page, visual_id, kind, tbl, field FROM {model_rules.BROKEN_SQL}")
def broken_fields(v):
    return model_rules.broken_fields(v).select("page", "visual_id", "kind", "tbl", "field")


for _kind, _of in (("measure", "m"), ("column", "col")):

    def _usage(v, kind=_kind):
        return attribution.usage(v, kind)

    _usage.__name__ = f"{_kind}_usage"
    query(f"SELECT o.tbl, o.name, count(DISTINCT page) AS pages, count(DISTINCT visual_id) AS visuals FROM (SELECT DISTINCT tbl, name FROM {_of}) o JOIN rf ON rf.field = o.name AND kind = '{_kind}' AND (rf.tbl IS NULL OR o.tbl IS NULL OR rf.tbl = o.tbl) GROUP BY o.tbl, o.name")(_usage)


@query("SELECT page, field, arg_min(coalesce(tbl, '-'), ord * 100 + ref_ord) AS tbl, field IN (SELECT name FROM m) AS in_model FROM rf WHERE kind = 'measure' GROUP BY page, field")
def page_measures(v):
    return attribution.page_measures(v).withColumn("tbl", F.coalesce("tbl", F.lit("-")))


@query("SELECT name, arg_max(tbl, ord) AS column_table FROM col WHERE name IN (SELECT name FROM m) GROUP BY name")
def name_collision_tables(v):
    return model_rules.name_collisions(v).select("name", "column_table").distinct()


@query(f"SELECT page, is_hidden, visuals, slicers, fields, grids, repeated, score, band FROM {model_rules.PAGES_SQL}")
def page_complexity(v):
    return model_rules.page_complexity(v)


@query("SELECT name, list_aggregate(list(tbl ORDER BY tbl), 'string_agg', ' and ') AS tables FROM m GROUP BY name HAVING count(*) > 1")
def duplicate_names(v):
    return v.get("dv_measures").groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("tbl")), " and ").alias("tables"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


@query("SELECT ord, a FROM rel WHERE a = b")
def self_loops(v):
    return v.get("dv_relations").where("a = b").select("ord", "a")


# --- graphs -----------------------------------------------------------------------------


@query(f"SELECT name, depth FROM {graph.DEPTHS_SQL}")
def dependency_depth(v):
    return graph.depths(v.calls())


@query(f"SELECT name, reached FROM {graph.CLOSURE_SQL}")
def call_closure(v):
    return graph.closure(v.calls())


@query(f"SELECT ord, a, b FROM {graph.CLOSING_SQL}")
def loop_closing_relations(v):
    return graph.closing_edges(v.get("dv_relations").where("active").select("ord", "a", "b"))


@query(f"SELECT ord, name, tbl, n FROM {attribution.closure_sql('mentions')}")
def closure_table_counts(v):
    return attribution.closure_mentions(v)


@query(f"SELECT ord, name, home, primary_table, confidence, n, second FROM {attribution.primary_sql('mentions')}")
def primary_table(v):
    return attribution.primary_tables(v)


@query(f"SELECT coalesce(primary_table, home) AS tbl, count(*) AS measures, count(*) FILTER (WHERE coalesce(primary_table, home) <> home) AS moved_in FROM {attribution.primary_sql('mentions')} GROUP BY 1")
def measures_by_source_table(v):
    return attribution.table_groups(v)


@query(f"SELECT visual_id, page, field, tbl, label, source, distance FROM {attribution.KPI_SQL}")
def kpi_names(v):
    return attribution.kpi_names(v).drop("ord")


@query(f"SELECT tbl, field, label, source FROM {attribution.KPI_SQL} QUALIFY row_number() OVER (PARTITION BY tbl, field ORDER BY CASE source WHEN 'visual-title' THEN 0 WHEN 'caption-near' THEN 2 ELSE 1 END, coalesce(distance, 0), ord) = 1")
def best_kpi_names(v):
    return attribution.best_kpi_names(v)


@query("SELECT page, type, count(*) AS n FROM v WHERE type IN ('slicer', 'textbox') OR visual_id NOT IN (SELECT visual_id FROM rf WHERE kind = 'measure') GROUP BY page, type")
def excluded_visuals(v):
    return attribution.excluded_visuals(v)


@query(f"SELECT src AS a, dst AS b, about FROM {lineage.EDGES_SQL} WHERE kind = 'related'")
def related_kpis(v):
    return lineage.related(v).select(F.col("src").alias("a"), F.col("dst").alias("b"), "about")


@query(f"SELECT src, dst, kind, about FROM {lineage.EDGES_SQL}")
def lineage_edges(v):
    return lineage.edges(v)


@query(f"SELECT src, dst, kind, about FROM {lineage.edges_sql('s0_3')}")
def lineage_of_a_page(v):
    return lineage.edges(v, "s0_3")


@query(f"SELECT node FROM {lineage.connected_sql('measure:Measures[MSR_000028]')}")
def lineage_of_a_measure(v):
    return lineage.connected(lineage.edges(v), "measure:Measures[MSR_000028]")


@query(f"SELECT kind, count(*) AS n FROM (SELECT DISTINCT split_part(x, ':', 1) AS kind, x FROM (SELECT src AS x FROM {lineage.EDGES_SQL} UNION ALL SELECT dst FROM {lineage.EDGES_SQL})) GROUP BY kind")
def lineage_nodes(v):
    return lineage.node_counts(lineage.edges(v))


# --- findings as a whole ------------------------------------------------------------------

_ALL_QA = " UNION ALL ".join([f"SELECT '{r.id}' AS rule_id, '{r.category}' AS category, '{r.severity}' AS severity, name AS target FROM {_QA[r.id]}" for r in QA] + [s for n, s in model_rules.SQL.items() if n.startswith("qa_")])
_RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END"
_TENTHS = "CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 6 WHEN 'medium' THEN 3 ELSE 1 END"
_POPULATION = "(SELECT unnest(['DAX', 'Model', 'Relationship', 'Report', 'Data']) AS category, unnest([a, a + b, c, d, a + c]) AS population FROM (SELECT (SELECT count(*) FROM m) AS a, (SELECT count(*) FROM tab) AS b, (SELECT count(*) FROM rel) AS c, (SELECT count(*) FROM pg) AS d))"
_SCORES = f"(SELECT category, coalesce(CAST(affected AS BIGINT), 0) AS affected, population, CASE WHEN population > 0 THEN CAST(least(100, greatest(0, floor(100.0::DOUBLE * (1.0::DOUBLE - coalesce(affected, 0) / (population * 10.0::DOUBLE)) + 0.5))) AS BIGINT) END AS score FROM {_POPULATION} LEFT JOIN (SELECT category, sum(t) AS affected FROM (SELECT category, target, max({_TENTHS}) AS t FROM ({_ALL_QA}) GROUP BY ALL) GROUP BY category) USING (category))"
_IDS = f"(SELECT *, rule_id || '#' || target || '#' || CAST(row_number() OVER (PARTITION BY rule_id, target ORDER BY severity) - 1 AS VARCHAR) AS finding_id FROM ({_ALL_QA}))"


@query(f"SELECT * FROM ({_ALL_QA})")
def qa_findings(v):
    return quality.qa_findings(v)


@query(f"SELECT rule_id, category, severity, target, finding_id FROM {_IDS}")
def qa_finding_ids(v):
    return quality.identified(quality.qa_findings(v))


@query(f"SELECT x.severity, count(q.severity) AS n FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS severity) x LEFT JOIN ({_ALL_QA}) q USING (severity) GROUP BY x.severity")
def severity_histogram(v):
    return quality.severities(quality.qa_findings(v))


@query(f"SELECT rule_id, category, severity, target, {_RANK} AS severity_rank FROM ({_ALL_QA}) ORDER BY severity_rank, category, target, rule_id LIMIT 5")
def qa_top_problems(v):
    return quality.top_problems(v)


@query(f"SELECT * FROM {_SCORES}")
def qa_scores(v):
    return quality.scores(v)


@query(f"SELECT CAST(floor(avg(score) + 0.5) AS BIGINT) AS overall FROM {_SCORES}")
def qa_overall_score(v):
    return quality.overall(v)


@query(f"SELECT * FROM {_SCORES} WHERE category = 'DAX'")
def dax_score(v):
    return quality.scores(v).where("category = 'DAX'")


_DECISIONS = "(SELECT finding_id, CASE length(finding_id) % 4 WHEN 0 THEN 'flagged' WHEN 1 THEN 'resolved' ELSE 'ignored' END AS state FROM {0} WHERE length(finding_id) % 4 < 3)".format


@query(f"SELECT x.severity, count(*) FILTER (WHERE q.severity IS NOT NULL AND coalesce(state, 'open') IN ('open', 'flagged')) AS outstanding, count(*) FILTER (WHERE state = 'flagged') AS flagged, count(*) FILTER (WHERE state = 'resolved') AS resolved, count(*) FILTER (WHERE state = 'ignored') AS ignored FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS severity) x LEFT JOIN {_IDS} q USING (severity) LEFT JOIN {_DECISIONS(_IDS)} d USING (finding_id) GROUP BY x.severity")
def inbox_counts(v):
    # read twice, so the rules run once
    hits = staged(quality.identified(quality.qa_findings(v)), "hits").hint("merge")
    triage = hits.where("length(finding_id) % 4 < 3").select("finding_id", F.expr("CASE length(finding_id) % 4 WHEN 0 THEN 'flagged' WHEN 1 THEN 'resolved' ELSE 'ignored' END").alias("state"))
    return quality.inbox(hits, triage)


# --- duplicates, edits, audits, versions ------------------------------------------------------


@query(f"SELECT * FROM {duplicates.GROUPS_SQL}".replace("{crefs}", model_rules._CREFS))
def duplicate_sources(v):
    return duplicates.duplicate_groups(v)


@query("SELECT change_id, 'measure' AS clash FROM ch WHERE field = 'name' AND target_type = 'measure' AND EXISTS (SELECT 1 FROM m WHERE m.name = ch.after AND NOT (m.name = ch.name AND m.tbl = ch.tbl)) UNION ALL SELECT change_id, 'table' FROM ch WHERE field = 'name' AND target_type = 'table' AND after IN (SELECT name FROM tab) UNION ALL SELECT change_id, 'column' FROM ch WHERE field = 'name' AND target_type = 'column' AND EXISTS (SELECT 1 FROM col WHERE col.tbl = ch.tbl AND col.name = ch.after)")
def rename_collisions(v):
    return edits.collisions(v)


@query("WITH u AS (SELECT field, count(DISTINCT page) AS pages, count(DISTINCT visual_id) AS visuals FROM rf WHERE kind = 'measure' GROUP BY field), c AS (SELECT x, count(DISTINCT name || '|' || ord) AS n FROM (SELECT ord, name, unnest(regexp_extract_all(expression, '\\[([^\\]\\r\\n]+)\\]', 1)) AS x FROM m) WHERE x <> name GROUP BY x) SELECT change_id, coalesce(pages, 0) AS pages, coalesce(visuals, 0) AS visuals, coalesce(n, 0) AS measures FROM ch LEFT JOIN u ON u.field = ch.name LEFT JOIN c ON c.x = ch.name WHERE ch.field = 'name' AND target_type = 'measure'".replace("WITH u AS", "SELECT * FROM (WITH u AS") + ")")
def rename_previews(v):
    return edits.previews(v)


@query("SELECT file, target_type, tbl, name, field, max(seq) AS seq, arg_max(change_id, seq) AS change_id, arg_max(after, seq) AS after, count(*) AS changes FROM ch GROUP BY file, target_type, tbl, name, field")
def latest_changes(v):
    return edits.latest_per_target(v)


@query(f"SELECT * FROM {replay.CHANGES_SQL}")
def replayed_changes(v):
    return replay.Replay(v).changes()


@query(f"SELECT * FROM {replay.EXPRESSIONS_SQL}")
def replayed_expressions(v):
    return replay.Replay(v).expressions()


@query(f"SELECT * FROM {replay.BINDINGS_SQL}")
def replayed_bindings(v):
    return replay.Replay(v).bindings()


@query(f"SELECT * FROM {replay.ENDS_SQL}")
def replayed_relation_ends(v):
    return replay.Replay(v).relation_ends()


_audited = lambda of, by, key, compared: f"(SELECT {', '.join(f'coalesce(x.{k}, y.{k}) AS {k}' for k in key)}, CASE WHEN y.ord IS NULL THEN 'missing' WHEN x.ord IS NULL THEN 'extra' WHEN {' OR '.join(f'x.{c} IS DISTINCT FROM y.{c}' for c in compared)} THEN 'differs' END AS problem FROM {of} x FULL JOIN {by} y ON {' AND '.join(f'x.{k} = y.{k}' for k in key)})"
_ONCE = r"(SELECT ord, tbl, name, trim(regexp_replace(expression, '\s+', ' ', 'g')) AS plain FROM {0} WHERE name NOT IN (SELECT name FROM m GROUP BY name HAVING count(*) > 1))".format


@query(f"SELECT * FROM {_audited('of_columns', 'by_columns', ['tbl', 'name'], ['data_type'])} WHERE problem IS NOT NULL")
def audit_columns(v):
    return edits.audit(v.get("dv_columns"), v.get("dx_columns"), ["tbl", "name"], ["data_type"])


@query(f"SELECT * FROM {_audited(_ONCE('of_measures'), _ONCE('by_measures'), ['tbl', 'name'], ['plain'])} WHERE problem IS NOT NULL")
def audit_measures(v):
    twice = model_rules.same_names(v).select("name").distinct()
    return edits.measure_audit(*(v.get(x).join(twice, "name", "left_anti") for x in ("dv_measures", "dx_measures")))


@query(f"SELECT * FROM {_audited('of_relations', 'by_relations', ['ord'], ['active', 'from_many', 'to_many', 'both_directions'])} WHERE problem IS NOT NULL")
def audit_relations(v):
    return edits.audit(v.get("dv_relations"), v.get("dx_relations"), ["ord"], ["active", "from_many", "to_many", "both_directions"])


@query(edits.audit_sql())
def audit_model(v):
    return edits.model_audit(edits.objects(v, "dv"), edits.objects(v, "dx"))


@query("SELECT rule_id, target FROM (SELECT 'DQ-MEASURE-MISSING-DEPENDENCY' AS rule_id, name AS target FROM r WHERE ref LIKE '%7' AND ref IN (SELECT name FROM m) AND name NOT LIKE '%7' AND name NOT IN (SELECT name FROM " + model_rules.MISSING_SQL + ") UNION SELECT 'REP-BROKEN-FIELD', page || '/' || visual_id FROM rf WHERE kind = 'measure' AND field LIKE '%7' AND field IN (SELECT name FROM m) AND visual_id NOT IN (SELECT visual_id FROM " + model_rules.BROKEN_SQL + "))")
def export_regressions(v):
    class Later(Views):
        def __init__(self):
            self.get = lambda name: v.get(name).where("name NOT LIKE '%7'") if name == "dv_measures" else v.get(name)

    of = lambda x: quality.identified(x.get and model_rules.RULES["qa_dq_measure_missing_dependency"](x).union(model_rules.RULES["qa_rep_broken_field"](x)))
    return quality.regressions(of(v), of(Later())).select("rule_id", "target").join(of(v).select("rule_id", "target"), ["rule_id", "target"], "left_anti").distinct()


@query("SELECT * FROM (SELECT 'f' || CAST(file AS VARCHAR) || '_' || CAST(seq % 40 AS VARCHAR) AS sha256, max(seq) AS created FROM ch GROUP BY 1) ORDER BY created DESC, sha256 LIMIT 25")
def version_history(v):
    return edits.versions(v.get("dv_changes").select(F.concat(F.lit("f"), F.col("file").cast("string"), F.lit("_"), (F.col("seq") % 40).cast("string")).alias("sha256"), F.col("seq").alias("created")))


# --- search and lists ------------------------------------------------------------------------------


@query("SELECT kind, label FROM (SELECT 1 AS k, 'table' AS kind, name AS label, ord FROM tab UNION ALL SELECT 2, 'measure', name, ord FROM m UNION ALL SELECT 3, 'page', display_name, ord FROM pg) WHERE contains(lower(label), 't1') OR contains(lower(label), '_0000') ORDER BY k, ord LIMIT 12")
def search_model(v):
    return search.found(v, ["t1", "_0000"])


@query("SELECT m.ord, m.name FROM m LEFT JOIN (SELECT tbl, field, label FROM " + attribution.KPI_SQL + " QUALIFY row_number() OVER (PARTITION BY tbl, field ORDER BY CASE source WHEN 'visual-title' THEN 0 WHEN 'caption-near' THEN 2 ELSE 1 END, coalesce(distance, 0), ord) = 1) k ON k.field = m.name AND k.tbl = m.tbl WHERE contains(lower(m.name || ' ' || m.tbl || ' ' || expression || ' ' || coalesce(label, '')), 'caption 1') OR contains(lower(expression), 'divide')")
def measure_list(v):
    return search.measures_with(v, ["caption 1", "divide"])


@query("SELECT tbl, name, CASE WHEN connector = 'Odbc.DataSource' THEN 'folded' ELSE 'native' END AS kind FROM pt")
def query_list(v):
    return search.query_list(v)


@query(f"SELECT name, CASE WHEN primary_table IS NOT NULL THEN 'table' WHEN confidence = 'low' THEN 'several tables' ELSE 'unmapped' END AS section FROM {attribution.primary_sql('mentions')}")
def document_sections(v):
    return search.sections(v)


@query("SELECT DISTINCT a AS tbl, b AS depends_on FROM rel UNION SELECT b, a FROM rel")
def table_dependencies(v):
    rel = v.get("dv_relations")
    return rel.select(F.col("a").alias("tbl"), F.col("b").alias("depends_on")).union(rel.select("b", "a")).distinct()


# --- parts of project files ---------------------------------------------------------------------------


def _parts(v: Views) -> DataFrame:
    """Parts with their bytes: every third one UTF-16LE, some with a byte order mark."""
    rows = v.get("dv_parts")
    return rows.withColumn("bytes", parts.encoded(F.col("doc"), F.col("place") % 3 == 0, F.col("place") % 2 == 0)).drop("doc")


_FORMATS = "SELECT * FROM (SELECT file, CASE WHEN schema IS NOT NULL THEN 'pbit' WHEN coalesce(bim, tmdl, report) IS NOT NULL THEN 'pbip' WHEN binary_model THEN 'pbix' END AS format, CASE WHEN schema IS NOT NULL THEN schema ELSE bim END AS model_part, CASE WHEN schema IS NULL AND coalesce(bim, tmdl, report) IS NOT NULL THEN report ELSE layout END AS layout_part FROM (SELECT file, arg_min(part, place) FILTER (WHERE lower(ltrim(part, '/')) = 'datamodelschema') AS schema, arg_min(part, place) FILTER (WHERE part = 'model.bim' OR part LIKE '%.SemanticModel/model.bim') AS bim, arg_min(part, place) FILTER (WHERE part LIKE '%.SemanticModel/definition/%.tmdl') AS tmdl, coalesce(arg_min(part, place) FILTER (WHERE part LIKE '%.Report/report.json'), arg_min(part, place) FILTER (WHERE part = 'report.json')) AS report, bool_or(lower(ltrim(part, '/')) = 'datamodel') AS binary_model, arg_min(part, place) FILTER (WHERE lower(ltrim(part, '/')) = 'report/layout') AS layout FROM pa GROUP BY file)) WHERE format IS NOT NULL"


@query(_FORMATS)
def detect_formats(v):
    return parts.detected(_parts(v))


_RUN = "CASE WHEN category <> 'Report' THEN CASE WHEN model_part IS NULL THEN 0 ELSE n END WHEN layout_part IS NULL THEN 0 WHEN model_part IS NULL THEN n - 1 ELSE n END"


@query(f"SELECT file, category, CAST({_RUN} AS BIGINT) AS rules_run, CAST(n - ({_RUN}) AS BIGINT) AS rules_skipped, CASE WHEN model_part IS NULL THEN 'No model part.' WHEN category = 'Report' AND layout_part IS NULL THEN 'No report part.' END AS reason FROM ({_FORMATS}), (VALUES ('DAX', 7), ('Model', 4), ('Relationship', 4), ('Report', 4), ('Data', 4)) x(category, n)")
def rules_run_and_skipped(v):
    return quality.rules_run(quality.capabilities(parts.detected(_parts(v))))


@query("SELECT file, part, place, CASE WHEN json_valid(doc) THEN doc END AS text, CASE WHEN json_valid(doc) THEN CASE WHEN place % 3 = 0 THEN 'utf-16le' ELSE 'utf-8' END END AS encoding, CASE WHEN json_valid(doc) THEN place % 2 = 0 END AS bom FROM pa")
def decode_parts(v):
    return parts.decoded(_parts(v)).drop("bytes")


_MODELS = "(SELECT file, unnest(CAST(coalesce(json_extract(doc, '$.model.tables'), json_extract(doc, '$.tables')) AS JSON[])) AS t FROM pa WHERE json_valid(doc))"


@query(f"SELECT file, json_extract_string(t, '$.name') AS tbl, json_extract_string(x, '$.name') AS name, CASE WHEN json_type(x, '$.expression') = 'ARRAY' THEN array_to_string(json_extract_string(x, '$.expression[*]'), chr(10)) ELSE json_extract_string(x, '$.expression') END AS expression, coalesce(json_extract_string(x, '$.isHidden') = 'true', false) AS is_hidden FROM (SELECT file, t, unnest(CAST(json_extract(t, '$.measures') AS JSON[])) AS x FROM {_MODELS})")
def parse_measures(v):
    return parts.measures(parts.models(parts.decoded(_parts(v)))).drop("ord")


@query(f"SELECT file, json_extract_string(t, '$.name') AS tbl, json_extract_string(x, '$.name') AS name, coalesce(json_extract_string(x, '$.dataType'), 'unknown') AS data_type FROM (SELECT file, t, unnest(CAST(json_extract(t, '$.columns') AS JSON[])) AS x FROM {_MODELS})")
def parse_columns(v):
    return parts.columns(parts.models(parts.decoded(_parts(v)))).drop("ord")


@query(f"SELECT kind, property, count(*) AS n FROM (SELECT 'table' AS kind, unnest(json_keys(t)) AS property FROM {_MODELS} UNION ALL SELECT 'column', unnest(json_keys(x)) FROM (SELECT unnest(CAST(json_extract(t, '$.columns') AS JSON[])) AS x FROM {_MODELS}) UNION ALL SELECT 'measure', unnest(json_keys(x)) FROM (SELECT unnest(CAST(json_extract(t, '$.measures') AS JSON[])) AS x FROM {_MODELS})) GROUP BY kind, property")
def model_coverage(v):
    return parts.coverage(parts.decoded(_parts(v)))


@query("SELECT ord, replace(replace(replace(replace(expression, '#', '#(#)'), chr(10), '#(lf)'), chr(9), '#(tab)'), '\"', '\"\"') AS written, expression AS read FROM m")
def m_strings(v):
    written = parts.encode_m(F.col("expression"))
    return v.get("dv_measures").select("ord", written.alias("written"), parts.decode_m(written).alias("read"))


_CONTENTS = "(SELECT file, sha256(string_agg(part || ':' || sha256(doc), chr(10) ORDER BY part, sha256(doc))) AS sha256 FROM pa GROUP BY file)"


@query(f"SELECT sha256, max_by(created, batch) AS created, max_by(name, batch) AS name FROM (SELECT sha256, 2 * file AS created, 'first ' || file AS name, 0 AS batch FROM {_CONTENTS} WHERE file % 3 > 0 UNION ALL SELECT sha256, 3 * file % 700, 'again ' || file, 1 FROM {_CONTENTS} WHERE file % 2 = 0) GROUP BY sha256 ORDER BY 2 DESC, 1 LIMIT 25")
def stored_versions(v):
    spark = v.get("dv_parts").sparkSession
    hashes = versions.content_hashes(v.get("dv_parts").withColumn("bytes", F.encode("doc", "UTF-8")))
    store = versions.VersionStore(spark, f"versions_{uuid.uuid4().hex}")
    store.save(hashes.where("file % 3 > 0").select("sha256", F.expr("2 * file AS created"), F.concat(F.lit("first "), F.col("file").cast("string")).alias("name")), 0)
    store.save(hashes.where("file % 2 = 0").select("sha256", F.expr("3 * file % 700 AS created"), F.concat(F.lit("again "), F.col("file").cast("string")).alias("name")), 1)
    return store.kept()
