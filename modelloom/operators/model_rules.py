"""Rules that join or group the model's frames, as findings (rule_id, category, severity, target), with the SQL that says the same.

SQL stands on m (measures), r (references), v (visuals), rf (what they bind), pg (pages), rel (relations), tab (tables), col (columns)
and the nesting tables of the registry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans.derived import view
from ..plans.stage import staged
from . import graph

#: Names of tables that the tool makes for dates by itself begin so.
AUTO_DATE = ("LocalDateTable_", "DateTableTemplate_")
#: A long chain; visuals that are grids, and how many fields make one large.
CHAIN, GRIDS, LARGE = 5, ("tableEx", "table", "pivotTable", "matrix"), 8


#: Frames that stay short, or are joined with longer ones; all others are joined by sorting (see derived.LONG).
SHORT = ("dv_tables", "dv_columns", "dv_relations", "dv_partitions")


class Views:
    """The frames of the model, each read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.get = lambda name: view(spark, sf_dir, name)

    #: Frames written once; None where each use makes its frame anew.
    _kept: dict[str, DataFrame] | None = None

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The frame that `make` gives; where many rules read it (`shared`), written once."""
        if self._kept is None:
            return make()
        if name not in self._kept:
            rows = staged(make(), name)
            self._kept[name] = rows if name in SHORT else rows.hint("merge")
        return self._kept[name]

    def shared(self) -> Views:
        """These views for a whole catalogue of rules: every frame is derived, masked and cut into references once."""
        out = Views.__new__(Views)
        out._kept, get = {}, self.get
        out.get = lambda name: out.once(name, lambda: get(name))
        return out

    def measures(self) -> DataFrame:
        masked = lambda: self.get("dv_measures").withColumn("masked", text.mask_dax(F.col("expression")))
        return self.once("masked_measures", lambda: masked().withColumn("bare", text.blank_names(F.col("masked"))))

    def refs(self) -> DataFrame:
        return self.once("refs", lambda: self.measures().select("name", F.explode(text.referenced_measures(F.col("masked"))).alias("ref")))

    def calls(self) -> DataFrame:
        """(name, ref): which measure calls which other one that there is, each once."""
        known = self.get("dv_measures").select(F.col("name").alias("ref"))
        return self.refs().where("name <> ref").join(known, "ref", "left_semi").select("name", "ref").distinct()

    def column_refs(self) -> DataFrame:
        """(name, tbl, col): columns that a measure names after their table."""
        return self.once("column_refs", lambda: self.measures().select("name", F.explode(text.referenced_columns(F.col("masked"))).alias("c")).select("name", "c.tbl", F.col("c.name").alias("col")))


def is_auto(name: str):
    return F.col(name).startswith(AUTO_DATE[0]) | F.col(name).startswith(AUTO_DATE[1])


def _quoted(severity: str) -> str:
    return severity if severity.startswith("CASE") else f"'{severity}'"


def _hits(rows: DataFrame, rule: str, category: str, severity: str, target: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.expr(_quoted(severity)).alias("severity"), F.expr(target).alias("target"))


RULES, SQL = {}, {}


def _add(rule: str, category: str, severity: str, target: str, rows, sql: str) -> None:
    """Registers `rule` as a query: `rows` makes its hits from the views, `sql` is what follows SELECT's list. Both engines read `severity` and `target`."""
    name = rule.lower().replace("-", "_")
    name = name if name.startswith("opt_") else f"qa_{name}"
    RULES[name] = lambda views: _hits(rows(views), rule, category, severity, target)
    SQL[name] = f"SELECT '{rule}' AS rule_id, '{category}' AS category, {_quoted(severity)} AS severity, {target} AS target {sql}"


_NOT_AUTO = f"NOT (starts_with({{0}}, '{AUTO_DATE[0]}') OR starts_with({{0}}, '{AUTO_DATE[1]}'))".format

# --- relations and tables ------------------------------------------------------


def _relations(condition: str):
    return lambda v: v.get("dv_relations").where(condition)


_ENDS = "a || ' -> ' || b"
for _rule, _category, _level, _where in (
    ("REL-MANY-TO-MANY", "Relationship", "high", "from_many AND to_many"), ("REL-BIDIRECTIONAL", "Relationship", "medium", "both_directions"), ("REL-INACTIVE", "Relationship", "low", "NOT active"),
    ("OPT-REL-MANY-TO-MANY", "Relationship", "high", "from_many AND to_many"), ("OPT-REL-BIDIRECTIONAL", "Relationship", "medium", "both_directions"), ("OPT-REL-INACTIVE", "Relationship", "low", "NOT active"),
):
    _add(_rule, _category, _level, _ENDS, _relations(_where), f"FROM rel WHERE {_where}")


def _orphans(v: Views) -> DataFrame:
    """Tables with a column that no relation ends at: an anti-join against both ends, if there are two tables or more."""
    rel, tables = v.get("dv_relations"), v.get("dv_tables")
    ends = rel.select(F.col("a").alias("name")).union(rel.select(F.col("b").alias("name")))
    two = tables.agg((F.count(F.lit(1)) >= 2).alias("two"))
    held = tables.where(~is_auto("name")).join(v.get("dv_columns").select(F.col("tbl").alias("name")), "name", "left_semi")
    # one row of one boolean, so the side is broadcast
    return held.join(ends, "name", "left_anti").join(F.broadcast(two), F.col("two"))


_ORPHANS = f"FROM tab WHERE {_NOT_AUTO('name')} AND (SELECT count(*) FROM tab) >= 2 AND name IN (SELECT tbl FROM col) AND name NOT IN (SELECT a FROM rel) AND name NOT IN (SELECT b FROM rel)"
_add("REL-ORPHAN-TABLE", "Relationship", "high", "name", _orphans, _ORPHANS)
_add("OPT-REL-ORPHAN-TABLE", "Relationship", "medium", "name", _orphans, _ORPHANS)
_add("OPT-REL-AMBIGUOUS-PATH", "Relationship", "high", _ENDS, lambda v: graph.closing_edges(v.get("dv_relations").where("active").select("ord", "a", "b")), f"FROM {graph.CLOSING_SQL}")
_add("MOD-TABLE-NO-DESCRIPTION", "Model", "low", "name", lambda v: v.get("dv_tables").where("trim(coalesce(description, '')) = '' AND NOT is_hidden").where(~is_auto("name")), f"FROM tab WHERE trim(coalesce(description, '')) = '' AND NOT is_hidden AND {_NOT_AUTO('name')}")


def _auto_date(v: Views) -> DataFrame:
    """One finding, on the first such table."""
    return v.get("dv_tables").where(is_auto("name")).agg(F.min_by("name", "ord").alias("name")).where("name IS NOT NULL")


_AUTO = f"FROM (SELECT arg_min(name, ord) AS name FROM tab WHERE NOT {_NOT_AUTO('name')}) WHERE name IS NOT NULL"
_add("MOD-AUTO-DATE-TABLES", "Model", "medium", "name", _auto_date, _AUTO)
_add("OPT-MOD-AUTO-DATE", "Model", "high", "name", _auto_date, _AUTO)


def name_collisions(v: Views) -> DataFrame:
    """Measures that share their name with a column, and the last such column's table."""
    last = v.get("dv_columns").groupBy("name").agg(F.max_by("tbl", "ord").alias("column_table"))
    return v.get("dv_measures").join(last, "name")


_add("MOD-NAME-COLLISION", "Model", "medium", "name", name_collisions, "FROM m WHERE name IN (SELECT name FROM col)")


def _mismatches(v: Views) -> DataFrame:
    """Relations whose end columns have known types that differ; of columns that share a name the last counts."""
    typed = v.get("dv_columns").groupBy("tbl", "name").agg(F.max_by("data_type", "ord").alias("type"))
    rel = v.get("dv_relations")
    for x in "ab":
        rel = rel.join(typed.select(F.col("tbl").alias(x), F.col("name").alias(f"column_{x}"), F.col("type").alias(f"type_{x}")), [x, f"column_{x}"])
    return rel.where("type_a <> type_b")


_type_of = lambda x: f"(SELECT arg_max(data_type, ord) FROM col WHERE col.tbl = {x} AND col.name = column_{x})"
_add("DQ-RELATIONSHIP-TYPE-MISMATCH", "Data", "high", _ENDS, _mismatches, f"FROM (SELECT a, b, {_type_of('a')} AS x, {_type_of('b')} AS y FROM rel) WHERE x <> y")

# --- what measures name ---------------------------------------------------------


def missing_dependencies(v: Views) -> DataFrame:
    """(name, ref): measures and columns that a measure names and the model lacks; of columns only those whose table there is."""
    lacking = v.refs().join(v.get("dv_measures").select(F.col("name").alias("ref")), "ref", "left_anti").select("name", F.concat(F.lit("["), "ref", F.lit("]")).alias("ref"))
    columns = v.column_refs().join(v.get("dv_tables").select(F.col("name").alias("tbl")), "tbl", "left_semi")
    columns = columns.join(v.get("dv_columns").select("tbl", F.col("name").alias("col")), ["tbl", "col"], "left_anti")
    return lacking.union(columns.select("name", F.concat("tbl", F.lit("["), "col", F.lit("]"))))


_CREFS = r"(SELECT DISTINCT name, ltrim(rtrim(split_part(x, '[', 1), chr(39)), chr(39)) AS tbl, regexp_extract(x, '\[(.*)\]$', 1) AS c FROM (SELECT name, unnest(regexp_extract_all(masked, '(?:\x27[^\x27]+\x27|\w+)\[[^\]\r\n]+\]')) AS x FROM m))"
MISSING_SQL = f"(SELECT name, '[' || ref || ']' AS ref FROM r WHERE ref NOT IN (SELECT name FROM m) UNION ALL SELECT name, tbl || '[' || c || ']' FROM {_CREFS} x WHERE tbl IN (SELECT name FROM tab) AND NOT EXISTS (SELECT 1 FROM col WHERE col.tbl = x.tbl AND col.name = x.c))"
_add("DQ-MEASURE-MISSING-DEPENDENCY", "Data", "critical", "name", lambda v: missing_dependencies(v).select("name").distinct(), f"FROM (SELECT DISTINCT name FROM {MISSING_SQL})")


def _no_date_table(v: Views) -> DataFrame:
    """Measures with time functions, if no table is marked as a date table."""
    marked = v.get("dv_tables").where("data_category = 'Time'").agg((F.count(F.lit(1)) == 0).alias("none"))
    # one row of one boolean, so the side is broadcast
    return v.measures().where(F.size(text.time_functions(F.col("bare"))) > 0).join(F.broadcast(marked), F.col("none"))


_add("DQ-NO-DATE-TABLE", "Data", "high", "name", _no_date_table, rf"FROM m WHERE NOT EXISTS (SELECT 1 FROM tab WHERE data_category = 'Time') AND regexp_matches(bare, '(?i)\b({'|'.join(text.TIME_FUNCTIONS)})\s*\(')")
_add("OPT-DAX-LONG-CHAIN", "DAX", "low", "name", lambda v: v.get("dv_measures").join(graph.deep(v.calls(), CHAIN).hint("merge"), "name"), f"FROM (SELECT m.name FROM m JOIN {graph.DEPTHS_SQL} d USING (name) WHERE depth >= {CHAIN})")
_add("OPT-DAX-NESTED-BRANCHING", "DAX", "medium", "name", lambda v: v.measures().where(F.greatest(text.nesting(F.col("bare"), "IF"), text.nesting(F.col("bare"), "SWITCH")) >= 4), "FROM m WHERE ord IN (SELECT ord FROM nesting_if WHERE deepest >= 4 UNION ALL SELECT ord FROM nesting_switch WHERE deepest >= 4)")
_add("OPT-DAX-COMPLEX", "DAX", "medium", "name", lambda v: v.measures().where((F.octet_length(F.encode("expression", "UTF-16LE")) > 1800) | (text.line_count(F.col("expression")) > 25)), r"FROM m WHERE length(expression) > 900 OR len(regexp_split_to_array(expression, '\r?\n')) > 25")
_add("OPT-DAX-FILTER-CALCULATE", "DAX", "medium", "name", lambda v: v.measures().where(text.count_calls(F.col("bare"), "FILTER") + text.count_calls(F.col("bare"), "CALCULATE") >= 5), r"FROM m WHERE len(regexp_extract_all(bare, '(?i)\bFILTER\s*\(')) + len(regexp_extract_all(bare, '(?i)\bCALCULATE\s*\(')) >= 5")
_add("MOD-NO-DESCRIPTION", "Model", "low", "name", lambda v: v.get("dv_measures").where("trim(coalesce(description, '')) = '' AND NOT is_hidden"), "FROM m WHERE trim(coalesce(description, '')) = '' AND NOT is_hidden")


def same_names(v: Views) -> DataFrame:
    """Every measure whose name another one has too."""
    twice = v.get("dv_measures").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return v.get("dv_measures").join(twice, "name", "left_semi")


_add("DQ-DUPLICATE-MEASURE-NAME", "Data", "medium", "name", same_names, "FROM m WHERE name IN (SELECT name FROM m GROUP BY name HAVING count(*) > 1)")
#: A call of FILTER whose first argument is a bare name.
WHOLE = r"(?i)\bFILTER\s*\(\s*([A-Za-z_]\w*)\s*,"


def _whole_tables(v: Views) -> DataFrame:
    """Measures that filter a known table as a whole; quoted names do not count."""
    hosts = v.measures().select("name", F.explode(F.regexp_extract_all("bare", F.lit(WHOLE), F.lit(1))).alias("host"))
    return hosts.join(v.get("dv_tables").select(F.col("name").alias("host")), "host", "left_semi").select("name").distinct()


_add("DAX-FILTER-WHOLE-TABLE", "DAX", "medium", "name", _whole_tables, f"FROM (SELECT DISTINCT name FROM (SELECT name, unnest(regexp_extract_all(bare, '{WHOLE}', 1)) AS host FROM m) WHERE host IN (SELECT name FROM tab))")

# --- what visuals bind ------------------------------------------------------------


def broken_fields(v: Views) -> DataFrame:
    """What visuals bind to a measure or column of a name that the model has nowhere: a row for each binding."""
    known = v.get("dv_measures").select("name", F.lit("measure").alias("kind")).union(v.get("dv_columns").select("name", F.lit("column")))
    return v.get("dv_refs").where("kind IN ('measure', 'column')").join(known.withColumnRenamed("name", "field"), ["kind", "field"], "left_anti")


BROKEN_SQL = "(SELECT * FROM rf WHERE (kind = 'measure' AND field NOT IN (SELECT name FROM m)) OR (kind = 'column' AND field NOT IN (SELECT name FROM col)))"
_VISUAL = "page || '/' || visual_id"
_add("REP-BROKEN-FIELD", "Report", "critical", _VISUAL, broken_fields, f"FROM {BROKEN_SQL}")
_add("REP-EMPTY-PAGE", "Report", "low", "page", lambda v: v.get("dv_pages").where("NOT is_hidden").join(v.get("dv_visuals").select("page"), "page", "left_anti"), "FROM pg WHERE NOT is_hidden AND page NOT IN (SELECT page FROM v)")


def large_grids(v: Views) -> DataFrame:
    return v.get("dv_refs").where(F.col("type").isin(*GRIDS)).groupBy("page", "visual_id").agg(F.count(F.lit(1)).alias("bound")).where(f"bound >= {LARGE}")


_GRIDS = f"(SELECT page, visual_id, count(*) AS bound FROM rf WHERE type IN {GRIDS} GROUP BY ALL HAVING count(*) >= {LARGE})"
_add("OPT-VIS-LARGE-GRID", "Visual", "medium", _VISUAL, large_grids, f"FROM {_GRIDS}")


def repeated_measures(v: Views) -> DataFrame:
    """(page, field, n): measures of over 400 UTF-16 units or 12 lines that three visuals or more of a page bind."""
    heavy = v.get("dv_measures").where((F.octet_length(F.encode("expression", "UTF-16LE")) > 800) | (text.line_count(F.col("expression")) > 12))
    uses = v.get("dv_refs").where("kind = 'measure'").join(heavy.select(F.col("name").alias("field")), "field", "left_semi")
    return uses.groupBy("page", "field").agg(F.count_distinct("visual_id").alias("n")).where("n >= 3")


_REPEATED = r"(SELECT page, field, count(DISTINCT visual_id) AS n FROM rf WHERE kind = 'measure' AND field IN (SELECT name FROM m WHERE length(expression) > 400 OR len(regexp_split_to_array(expression, '\r?\n')) > 12) GROUP BY ALL HAVING count(DISTINCT visual_id) >= 3)"
_add("OPT-VIS-REPEATED-MEASURE", "Visual", "medium", "page", lambda v: repeated_measures(v).select("page").distinct(), f"FROM (SELECT DISTINCT page FROM {_REPEATED})")


def page_complexity(v: Views) -> DataFrame:
    return v.once("page_complexity", lambda: _page_complexity(v))


def _page_complexity(v: Views) -> DataFrame:
    """For every page, hidden ones too, its visuals, slicers, distinct fields, large grids, repeated complex measures, score and band."""
    shown = v.get("dv_visuals").groupBy("page").agg(F.count(F.lit(1)).alias("visuals"), F.count_if(F.col("type") == "slicer").alias("slicers"))
    # fields are told by table and name, a missing table like one without a name
    fields = v.get("dv_refs").groupBy("page").agg(F.count_distinct(F.concat(F.coalesce("tbl", F.lit("")), F.lit("["), "field", F.lit("]"))).alias("fields"))
    pages = v.get("dv_pages").select("page", "is_hidden")
    for part in (shown, fields, large_grids(v).groupBy("page").agg(F.count(F.lit(1)).alias("grids")), repeated_measures(v).groupBy("page").agg(F.count(F.lit(1)).alias("repeated"))):
        pages = pages.join(part, "page", "left")
    pages = pages.fillna(0, ["visuals", "slicers", "fields", "grids", "repeated"])
    pages = pages.withColumn("score", F.least(F.lit(100), F.expr("visuals * 2 + slicers * 4 + grids * 6 + fields + repeated * 3")).cast("bigint"))
    return pages.withColumn("band", F.when(F.col("score") < 30, "simple").when(F.col("score") < 60, "moderate").when(F.col("score") < 80, "complex").otherwise("very complex"))


_of_page = lambda rows, what="*", where="true": f"(SELECT count({what}) FROM {rows} q WHERE q.page = pg.page AND {where})"
PAGES_SQL = f"""(SELECT *, CASE WHEN score < 30 THEN 'simple' WHEN score < 60 THEN 'moderate' WHEN score < 80 THEN 'complex' ELSE 'very complex' END AS band FROM (SELECT *, CAST(least(100, 2 * visuals + 4 * slicers + 6 * grids + fields + 3 * repeated) AS BIGINT) AS score FROM (
SELECT page, is_hidden, {_of_page('v')} AS visuals, {_of_page('v', where="type = 'slicer'")} AS slicers, {_of_page('rf', "DISTINCT coalesce(tbl, '') || '[' || field || ']'")} AS fields, {_of_page(_GRIDS)} AS grids, {_of_page(_REPEATED)} AS repeated FROM pg)))"""
_add("REP-PAGE-TOO-MANY-VISUALS", "Report", "CASE WHEN visuals > 30 THEN 'high' ELSE 'medium' END", "page", lambda v: page_complexity(v).where("visuals > 20"), f"FROM {PAGES_SQL} WHERE visuals > 20")
_add("REP-PAGE-TOO-MANY-SLICERS", "Report", "low", "page", lambda v: page_complexity(v).where("slicers > 6"), f"FROM {PAGES_SQL} WHERE slicers > 6")
_add("OPT-VIS-MANY-SLICERS", "Visual", "low", "page", lambda v: page_complexity(v).where("slicers > 6"), f"FROM {PAGES_SQL} WHERE slicers > 6")
_add("OPT-VIS-PAGE-COMPLEXITY", "Visual", "CASE WHEN score >= 80 THEN 'high' ELSE 'medium' END", "page", lambda v: page_complexity(v).where("score >= 60 AND NOT is_hidden"), f"FROM {PAGES_SQL} WHERE score >= 60 AND NOT is_hidden")

# --- what nothing uses ------------------------------------------------------------

_add("OPT-MOD-CALCULATED-COLUMN", "Model", "low", "tbl || '[' || name || ']'", lambda v: v.get("dv_columns").where("kind = 'calculated'").where(~is_auto("tbl")), f"FROM col WHERE kind = 'calculated' AND {_NOT_AUTO('tbl')}")
_add("OPT-MOD-HIGH-CARDINALITY", "Model", "medium", "tbl || '[' || name || ']'", lambda v: v.get("dv_columns").where("cardinality > 1000000"), "FROM col WHERE cardinality > 1000000")


def unused_measures(v: Views) -> DataFrame:
    """Measures that no visual binds and no other measure calls."""
    bound = v.get("dv_refs").where("kind = 'measure'").select(F.col("field").alias("name"))
    return v.get("dv_measures").join(bound, "name", "left_anti").join(v.refs().where("name <> ref").select(F.col("ref").alias("name")), "name", "left_anti")


_add("OPT-MOD-UNUSED-MEASURE", "Model", "medium", "name", unused_measures, "FROM m WHERE name NOT IN (SELECT field FROM rf WHERE kind = 'measure') AND name NOT IN (SELECT ref FROM r WHERE name <> ref)")


def used_columns(v: Views) -> DataFrame:
    """(tbl, name) of the columns that a visual binds, a measure names after their table or a relation ends at."""
    bound = v.get("dv_refs").where("kind = 'column'").select("tbl", F.col("field").alias("name"))
    rel = v.get("dv_relations")
    return bound.union(v.column_refs().select("tbl", "col")).union(rel.select("a", "column_a")).union(rel.select("b", "column_b")).where("tbl IS NOT NULL")


_USED = f"(SELECT tbl, field AS name FROM rf WHERE kind = 'column' UNION ALL SELECT tbl, c FROM {_CREFS} UNION ALL SELECT a, column_a FROM rel UNION ALL SELECT b, column_b FROM rel)"
_add("OPT-MOD-UNUSED-COLUMN", "Model", "low", "tbl || '[' || name || ']'", lambda v: v.get("dv_columns").where(~is_auto("tbl")).join(used_columns(v), ["tbl", "name"], "left_anti"), f"FROM col WHERE {_NOT_AUTO('tbl')} AND NOT EXISTS (SELECT 1 FROM {_USED} u WHERE u.tbl = col.tbl AND u.name = col.name)")


def mentions(v: Views) -> DataFrame:
    """(ord, name, tbl, n): how often a measure's expression names each table that there is."""
    named = v.measures().select("ord", "name", F.explode(text.table_mentions(F.col("masked"))).alias("tbl"))
    return named.join(v.get("dv_tables").select(F.col("name").alias("tbl")).distinct(), "tbl", "left_semi").groupBy("ord", "name", "tbl").agg(F.count(F.lit(1)).alias("n"))


#: Names in quotes, and bare ones with what is in quotes blanked; an odd quote ends the text.
_NAMES = r"SELECT ord, name, unnest(regexp_extract_all(masked, '\x27([^\x27]*)\x27', 1)) AS tbl FROM m UNION ALL SELECT ord, name, x FROM (SELECT ord, name, masked, unnest(regexp_extract_all(regexp_replace(masked, '\x27[^\x27]*(?:\x27|\z)', ' ', 'g'), '[A-Za-z_]\w*(?:\s*\()?')) AS x FROM m) WHERE NOT ends_with(x, '(') AND NOT list_contains(regexp_extract_all(masked, '(?i)\bVAR\s+([A-Za-z_]\w*)', 1), x)"
MENTIONS_SQL = f"(SELECT ord, name, tbl, count(*) AS n FROM ({_NAMES}) WHERE tbl IN (SELECT name FROM tab) GROUP BY ALL)"


def _unused_tables(v: Views) -> DataFrame:
    """Tables without measures that no relation, binding or column named in a measure belongs to; bare mentions do not count."""
    rel = v.get("dv_relations")
    named = v.get("dv_refs").select("tbl").where("tbl IS NOT NULL").union(rel.select("a")).union(rel.select("b")).union(v.get("dv_measures").select("tbl")).union(v.column_refs().select("tbl"))
    return v.get("dv_tables").where(~is_auto("name")).join(named.select(F.col("tbl").alias("name")), "name", "left_anti")


_add("OPT-MOD-UNUSED-TABLE", "Model", "high", "name", _unused_tables, f"FROM tab WHERE {_NOT_AUTO('name')} AND name NOT IN (SELECT tbl FROM {_USED} WHERE tbl IS NOT NULL) AND name NOT IN (SELECT tbl FROM rf WHERE tbl IS NOT NULL) AND name NOT IN (SELECT tbl FROM m)")
