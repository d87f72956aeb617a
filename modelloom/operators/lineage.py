"""Lineage in the direction in which data moves: source, table, measure, visual and the KPI that it reports, with what relates KPIs.

Nodes are told as kind:name. Only what a visual with a measure reaches is in it: calls are followed from those measures alone,
round by round, so no pair of nodes is made that is not on such a way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.stage import staged
from . import attribution, graph
from .model_rules import Views, mentions


def _node(kind: str, name: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), name)


_MEASURE = "concat('measure:', tbl, '[', name, ']')"
_VISUAL = "concat('visual:', page, '/', visual_id)"


def measures_by_key(v: Views) -> DataFrame:
    """(node, tbl, name, ord) of each table and name: of several measures the last. Expressions stay where they are."""
    last = v.get("dv_measures").groupBy("tbl", "name").agg(F.max("ord").alias("ord"))
    return last.select(F.expr(_MEASURE).alias("node"), "tbl", "name", "ord")


def shown(v: Views, page: str | None = None) -> DataFrame:
    """(page, visual_id, ref_ord, measure, tbl, name): measures that visuals show. A binding is resolved by table and name, else by the name alone,
    which stands for the last measure that has it; visuals of a type that shows no KPI are left out."""
    bound = v.get("dv_refs").where("kind = 'measure'").where(~F.col("type").isin(*attribution.NOT_KPI) & ~F.col("type").rlike("(?i)slicer|filter|navigator|button"))
    bound = (bound.where(F.col("page") == page) if page else bound).select("page", "visual_id", "ref_ord", F.col("tbl").alias("bound_tbl"), F.col("field").alias("name"))
    keyed = measures_by_key(v)
    named = keyed.groupBy("name").agg(F.max_by(F.struct("node", "tbl"), "ord").alias("by_name"))
    exact = keyed.select(F.col("node").alias("exact"), F.col("tbl").alias("bound_tbl"), "name")
    found = bound.join(exact, ["bound_tbl", "name"], "left").join(named, "name", "left").withColumn("measure", F.coalesce("exact", "by_name.node")).where("measure IS NOT NULL")
    return found.select("page", "visual_id", "ref_ord", "measure", F.when(F.col("exact").isNotNull(), F.col("bound_tbl")).otherwise(F.col("by_name.tbl")).alias("tbl"), "name")


def kpis(v: Views, on: DataFrame, few: bool = False) -> DataFrame:
    """(visual, kpi, label): what each visual of `on` (shown) reports: what captions call its first measure, else that measure's name.

    Where `on` shows `few` measures, captions are looked for at visuals that bind one of these only."""
    first = on.groupBy("page", "visual_id").agg(F.min_by(F.struct("tbl", "name"), "ref_ord").alias("m")).select("page", "visual_id", "m.tbl", "m.name")
    best = attribution.best_kpi_names(v, staged(first.select("tbl", F.col("name").alias("field")).distinct(), "first_measures") if few else None).select("tbl", F.col("field").alias("name"), "label")
    told = first.join(best, ["tbl", "name"], "left").withColumn("label", F.coalesce("label", "name"))
    return told.select(F.expr(_VISUAL).alias("visual"), _node("kpi", F.lower("label")).alias("kpi"), "label")


def calls(v: Views) -> DataFrame:
    """(caller, callee, name): measures that an expression names in brackets, behind a table or not, comments included; never itself."""
    keyed = measures_by_key(v)
    named = keyed.groupBy("name").agg(F.max_by("node", "ord").alias("callee"))
    # names are cut out before measures meet, so that no expression is shuffled
    found = v.get("dv_measures").select("tbl", F.col("name").alias("of"), "ord", F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(r"\[([^\]]+)\]"), F.lit(1)))).alias("name"))
    found = found.join(keyed.select("tbl", F.col("name").alias("of"), "ord", F.col("node").alias("caller")), ["tbl", "of", "ord"]).select("caller", "name")
    return found.join(named, "name").where("caller <> callee").select("caller", "callee", "name")


#: What FROM is followed by, with whatever quotes.
OBJECT = r"(?i)\bFROM\s+([A-Za-z0-9_$#.\x22\x27\x60\[\]]+)"


def source_objects(partitions: DataFrame) -> DataFrame:
    """(tbl, object): the first object that the first native statement of a table reads."""
    native = partitions.where("connector <> 'Odbc.DataSource'").groupBy("tbl").agg(F.min_by("statement", "ord").alias("statement"))
    return native.select("tbl", F.nullif(F.regexp_extract(text.mask_sql(F.col("statement")), OBJECT, 1), F.lit("")).alias("object")).where("object IS NOT NULL")


def _related(on: DataFrame, reported: DataFrame, called: DataFrame) -> DataFrame:
    """(src, dst, kind, about) of KPIs that show one measure or of which one's calls the other's, each pair once."""
    # postings of measures: KPIs that meet in one are related
    built = on.select(F.expr(_VISUAL).alias("visual"), "measure", "name").join(reported, "visual").select("kpi", "measure", "name").distinct()
    one, other = (built.select(F.col("kpi").alias(x), F.col("measure").alias(f"of_{x}"), F.col("name").alias(f"name_{x}")) for x in "ab")
    shared = one.join(other, F.col("of_a") == F.col("of_b")).where("a < b").select("a", "b", F.lit(0).alias("rank"), F.col("name_a").alias("about"))
    linked = one.join(called.select(F.col("caller").alias("of_a"), F.col("callee").alias("of_b")), "of_a").join(other, "of_b").where("a <> b")
    linked = linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).alias("rank"), F.col("name_b").alias("about"))
    return shared.union(linked).groupBy("a", "b").agg(F.min(F.struct("rank", "about")).alias("m")).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("related").alias("kind"), "m.about")


def related(v: Views) -> DataFrame:
    """The edges between KPIs alone: what feeds and reaches the measures does not decide them."""
    on = staged(shown(v), "shown")
    return _related(on, staged(kpis(v, on), "kpis"), staged(calls(v), "calls"))


def edges(v: Views, page: str | None = None) -> DataFrame:
    """(src, dst, kind, about), each once: reports (visual to KPI), calls (callee to caller), feeds (table to measure), displays (measure to
    visual), loads (source to table), related (KPIs that show one measure or of which one's calls the other's). `about` names
    what the edge stands for. With `page` only what that page's visuals reach."""
    on = staged(shown(v, page), "shown")
    reported = staged(kpis(v, on, few=page is not None), "kpis")
    called = staged(calls(v), "calls")
    reached = graph.reach(on.select(F.col("measure").alias("node")), called.select(F.col("caller").alias("src"), F.col("callee").alias("dst")))

    displays = on.select(F.col("measure").alias("src"), F.expr(_VISUAL).alias("dst"), F.lit("displays").alias("kind"), F.col("name").alias("about"))
    reports = reported.select(F.col("visual"), "kpi", F.lit("reports"), "label")
    calls_ = called.join(reached.withColumnRenamed("node", "caller"), "caller", "left_semi").select("callee", "caller", F.lit("calls"), "name")
    reads = measures_by_key(v).join(mentions(v).select("ord", F.col("tbl").alias("read")), "ord").join(reached, "node", "left_semi")
    feeds = staged(reads.select(_node("table", "read").alias("src"), F.col("node").alias("dst"), F.lit("feeds").alias("kind"), F.col("read").alias("about")), "feeds")
    loads = source_objects(v.get("dv_partitions")).join(feeds.select(F.col("about").alias("tbl")).distinct(), "tbl").select(_node("source", "object"), _node("table", "tbl"), F.lit("loads"), "object")

    return reduce(DataFrame.union, (displays, reports, calls_, feeds, loads, _related(on, reported, called))).groupBy("src", "dst", "kind").agg(F.min("about").alias("about"))


def connected(found: DataFrame, start: str) -> DataFrame:
    """(node): what `start` reaches along the edges, and what reaches it without passing through any of that, and itself."""
    found = staged(found.select("src", "dst"), "lineage")
    first = found.sparkSession.createDataFrame([(start,)], "node string")
    ahead = graph.reach(first, found)
    return graph.reach(first, found.select(F.col("dst").alias("src"), F.col("src").alias("dst")), known=ahead)


def node_counts(found: DataFrame) -> DataFrame:
    nodes = found.select(F.col("src").alias("node")).union(found.select("dst")).distinct()
    return nodes.groupBy(F.substring_index("node", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- the same for DuckDB --------------------------------------------------------


def edges_sql(page: str | None = None) -> str:
    only = f" AND page = '{page}'" if page else ""
    return rf"""(WITH RECURSIVE mk AS MATERIALIZED (SELECT tbl, name, arg_max(expression, ord) AS expression, max(ord) AS ord, 'measure:' || tbl || '[' || name || ']' AS node FROM m GROUP BY tbl, name),
lastn AS (SELECT name, arg_max(node, ord) AS node, arg_max(tbl, ord) AS tbl FROM mk GROUP BY name),
sh AS MATERIALIZED (SELECT 'visual:' || page || '/' || visual_id AS visual, ref_ord, x.name, CASE WHEN e.node IS NULL THEN l.node ELSE e.node END AS measure, CASE WHEN e.node IS NULL THEN l.tbl ELSE e.tbl END AS tbl FROM (SELECT page, visual_id, ref_ord, tbl AS bound, field AS name FROM rf WHERE kind = 'measure' AND type NOT IN ('slicer', 'textbox'){only}) x LEFT JOIN mk e ON e.tbl = x.bound AND e.name = x.name JOIN lastn l ON l.name = x.name),
bk AS (SELECT tbl, field, label FROM {attribution.KPI_SQL} QUALIFY row_number() OVER (PARTITION BY tbl, field ORDER BY CASE source WHEN 'visual-title' THEN 0 WHEN 'caption-near' THEN 2 ELSE 1 END, coalesce(distance, 0), ord) = 1),
kp AS MATERIALIZED (SELECT f.visual, coalesce(bk.label, f.name) AS label, 'kpi:' || lower(coalesce(bk.label, f.name)) AS kpi FROM (SELECT visual, arg_min(tbl, ref_ord) AS tbl, arg_min(name, ref_ord) AS name FROM sh GROUP BY visual) f LEFT JOIN bk ON bk.tbl = f.tbl AND bk.field = f.name),
ca AS MATERIALIZED (SELECT DISTINCT c.node AS caller, l.node AS callee, l.name FROM (SELECT node, unnest(regexp_extract_all(expression, '\[([^\]]+)\]', 1)) AS name FROM mk) c JOIN lastn l ON l.name = c.name WHERE l.node <> c.node),
re AS (SELECT measure AS node FROM sh UNION SELECT ca.callee FROM re JOIN ca ON ca.caller = re.node),
fe AS MATERIALIZED (SELECT DISTINCT x.tbl, mk.node FROM mk JOIN mentions x ON x.ord = mk.ord WHERE mk.node IN (SELECT node FROM re)),
src AS (SELECT tbl, regexp_extract(masked, '{OBJECT}', 1) AS object FROM (SELECT * FROM pt WHERE connector <> 'Odbc.DataSource' QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY ord) = 1)),
bu AS MATERIALIZED (SELECT DISTINCT kp.kpi, sh.measure, sh.name FROM sh JOIN kp USING (visual)),
rl AS (SELECT x.kpi AS a, y.kpi AS b, 0 AS rank, x.name AS about FROM bu x JOIN bu y ON y.measure = x.measure AND x.kpi < y.kpi UNION ALL SELECT least(x.kpi, y.kpi), greatest(x.kpi, y.kpi), 1, y.name FROM bu x JOIN ca ON ca.caller = x.measure JOIN bu y ON y.measure = ca.callee AND y.kpi <> x.kpi),
ed AS (SELECT measure AS src, visual AS dst, 'displays' AS kind, name AS about FROM sh UNION ALL SELECT visual, kpi, 'reports', label FROM kp UNION ALL SELECT callee, caller, 'calls', name FROM ca WHERE caller IN (SELECT node FROM re)
UNION ALL SELECT 'table:' || tbl, node, 'feeds', tbl FROM fe UNION ALL SELECT 'source:' || object, 'table:' || tbl, 'loads', object FROM src WHERE object <> '' AND tbl IN (SELECT tbl FROM fe)
UNION ALL SELECT a, b, 'related', about FROM rl QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY rank, about) = 1)
SELECT src, dst, kind, min(about) AS about FROM ed GROUP BY src, dst, kind)"""


EDGES_SQL = edges_sql()


def connected_sql(start: str) -> str:
    return f"(WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {EDGES_SQL}), a AS (SELECT '{start}' AS node UNION SELECT e.dst FROM a JOIN e ON e.src = a.node), b AS (SELECT '{start}' AS node UNION SELECT e.src FROM b JOIN e ON e.dst = b.node WHERE e.src NOT IN (SELECT node FROM a)) SELECT node FROM a UNION SELECT node FROM b)"
