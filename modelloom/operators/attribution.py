"""Which tables a measure stands on, who uses it, and what its visuals call it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.stage import staged
from . import graph
from .model_rules import Views, mentions

#: How far a leading table must be ahead, and the distances for captions.
DOMINANCE, GAP, RADIUS, SLACK = 1.5, 120.0, 320.0, 8.0
#: Visuals that are no KPI, and those whose text may caption another.
NOT_KPI = ["slicer", "advancedSlicerVisual", "textbox", "image", "shape", "basicShape", "actionButton", "bookmarkNavigator", "pageNavigator", "filterPane", "group"]
CAPTIONS = ["textbox", "shape", "actionButton", "basicShape"]


def closure_mentions(v: Views, own: DataFrame | None = None) -> DataFrame:
    """(name, tbl, n): references to each table by a measure and all measures that it reaches, each measure counted once.

    Names that several measures share stand for the last of them, as calls find it. `own`: the staged mentions, where they are there already."""
    own = (staged(mentions(v), "mentions") if own is None else own).hint("merge")
    last = staged(own.join(v.get("dv_measures").groupBy("name").agg(F.max("ord").alias("ord")), ["name", "ord"], "left_semi").select(F.col("name").alias("reached"), "tbl", "n"), "last_mentions").hint("merge")
    reached = graph.closure(raw_calls(v)).where("name <> reached")
    # summed by name first, then given to each measure that has it
    below = reached.hint("merge").join(last, "reached").groupBy("name", "tbl").agg(F.sum("n").alias("n"))
    further = v.get("dv_measures").select("ord", "name").join(below.hint("merge"), "name").select("ord", "name", "tbl", "n")
    return own.union(further).groupBy("ord", "name", "tbl").agg(F.sum("n").alias("n"))


def raw_calls(v: Views) -> DataFrame:
    """(name, ref) as the closure of sources reads calls: comments and strings are not blanked."""
    known = v.get("dv_measures").select(F.col("name").alias("ref"))
    found = v.get("dv_measures").select("name", F.explode(text.referenced_measures(F.col("expression"))).alias("ref"))
    return found.join(known, "ref", "left_semi").select("name", "ref").distinct()


def primary_tables(v: Views) -> DataFrame:
    """ord, name, primary table (null if none leads), confidence, references of the leader and of the runner-up of every measure."""
    order = Window.partitionBy("ord").orderBy(F.desc("n"), "tbl")
    own = staged(mentions(v), "mentions")
    ranked = closure_mentions(v, own).withColumns({"rank": F.row_number().over(order), "second": F.lead("n").over(order)}).where("rank = 1").select("ord", "tbl", "n", "second")
    direct = own.select("ord", "tbl", F.lit(True).alias("direct")).hint("merge")
    led = ranked.join(direct, ["ord", "tbl"], "left").withColumn("leads", F.expr(f"second IS NULL OR n >= second * {DOMINANCE}"))
    confidence = F.when(F.col("n").isNull(), "none").when(~F.col("leads"), "low").when(F.col("direct"), "high").otherwise("medium")
    return v.get("dv_measures").select("ord", "name", F.col("tbl").alias("home")).join(led, "ord", "left").select("ord", "name", "home", F.when(F.col("leads"), F.col("tbl")).alias("primary_table"), confidence.alias("confidence"), "n", "second")


def table_groups(v: Views) -> DataFrame:
    """(tbl, measures, moved_in): measures by the table that they stand on, else by their home table."""
    at = primary_tables(v).withColumn("tbl", F.coalesce("primary_table", "home"))
    return at.groupBy("tbl").agg(F.count(F.lit(1)).alias("measures"), F.count_if(F.col("home") != F.col("tbl")).alias("moved_in"))


def callers(v: Views) -> DataFrame:
    """(name, callers): by how many other measures each is named, in brackets with or without a table, comments included."""
    known = v.get("dv_measures").select(F.col("name").alias("ref"))
    found = v.get("dv_measures").select("name", F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(r"\[([^\]\r\n]+)\]"), F.lit(1)))).alias("ref"))
    return found.where("name <> ref").join(known, "ref", "left_semi").groupBy(F.col("ref").alias("name")).agg(F.count_distinct("name").alias("callers"))


def usage(v: Views, kind: str = "measure") -> DataFrame:
    """(tbl, name, pages, visuals) of every measure or column that a visual binds; a binding without a table fits any."""
    objects = v.get("dv_measures" if kind == "measure" else "dv_columns").select("tbl", "name").distinct()
    refs = v.get("dv_refs").where(F.col("kind") == kind).select(F.col("tbl").alias("bound"), F.col("field").alias("name"), "page", "visual_id")
    return objects.join(refs, "name").where("bound IS NULL OR tbl IS NULL OR bound = tbl").groupBy("tbl", "name").agg(F.count_distinct("page").alias("pages"), F.count_distinct("page", "visual_id").alias("visuals"))


def page_measures(v: Views) -> DataFrame:
    """(page, field, tbl, in_model): each measure a page binds, as the binding that comes first there names it."""
    first = v.get("dv_refs").where("kind = 'measure'").groupBy("page", "field").agg(F.min_by("tbl", F.struct("ord", "ref_ord")).alias("tbl"))
    return first.join(v.get("dv_measures").select(F.col("name").alias("field"), F.lit(True).alias("known")).distinct(), "field", "left").select("page", "field", "tbl", F.coalesce("known", F.lit(False)).alias("in_model"))


def caption_text(label: Column) -> Column:
    """White space squeezed; null unless that has 1 to 60 signs; then a colon at the end dropped, null if nothing is left."""
    clean = text.squeezed(label)
    return F.when(F.length(clean).between(1, 60), F.nullif(F.regexp_replace(clean, r"\s*:$", ""), F.lit("")))


def kpi_names(v: Views, of: DataFrame | None = None) -> DataFrame:
    """(visual_id, page, field, tbl, label, source, distance): what every measure is called where a visual binds it.

    A visual's own title counts for all its measures; the caption nearest to it (above, else left, else around) only if it
    binds one. Captions and visuals meet by page; of equal distances the earlier caption counts. With `of` (tbl, field) only for these measures."""
    visuals = v.get("dv_visuals").select("ord", "page", "visual_id", "type", "x", "y", "width", "height", caption_text(F.col("title")).alias("title"), caption_text(F.col("text")).alias("text"))
    bound = v.get("dv_refs").where("kind = 'measure'").select("visual_id", "field", "tbl")
    single = bound.groupBy("visual_id").agg(F.count(F.lit(1)).alias("bound")).where("bound = 1").select("visual_id")
    every = visuals
    if of is not None:
        bound = bound.join(of, ["tbl", "field"], "left_semi").select("visual_id", "field", "tbl")
        visuals = visuals.join(bound, "visual_id", "left_semi")
    captions = every.where(F.col("type").isin(*CAPTIONS) & F.col("text").isNotNull()).select("page", F.col("ord").alias("c_ord"), F.col("text").alias("label"), *(F.col(c).alias(f"c_{c}") for c in ("x", "y", "width", "height")))
    near = visuals.where("title IS NULL").join(single, "visual_id", "left_semi").join(captions, "page")
    near = near.withColumns({
        "above": F.expr(f"CASE WHEN c_x < x + width AND x < c_x + c_width AND c_y + c_height <= y + {SLACK} AND y - (c_y + c_height) <= {GAP} THEN y - (c_y + c_height) END"),
        "beside": F.expr(f"CASE WHEN c_y < y + height AND y < c_y + c_height AND c_x + c_width <= x + {SLACK} AND x - (c_x + c_width) <= {GAP} THEN x - (c_x + c_width) END"),
        "around": F.sqrt(F.pow(F.expr("c_x + c_width / 2 - x - width / 2"), 2) + F.pow(F.expr("c_y + c_height / 2 - y - height / 2"), 2)),
    })
    tier = F.when(F.col("above").isNotNull(), 0).when(F.col("beside").isNotNull(), 1).when(F.col("around") <= RADIUS, 2)
    near = near.withColumn("tier", tier).where("tier IS NOT NULL").withColumn("distance", F.coalesce("above", "beside", "around"))
    best = near.groupBy("visual_id").agg(F.min(F.struct("tier", "distance", "c_ord", "label")).alias("b"))
    source = F.element_at(F.array(*map(F.lit, ["caption-above", "caption-left", "caption-near"])), F.col("b.tier") + 1)
    told = best.select("visual_id", F.col("b.label").alias("label"), source.alias("source"), F.floor(F.col("b.distance") + 0.5).cast("bigint").alias("distance"))
    titled = visuals.where("title IS NOT NULL").select("visual_id", F.col("title").alias("label"), F.lit("visual-title").alias("source"), F.lit(None).cast("bigint").alias("distance"))
    return visuals.select("ord", "visual_id", "page").join(titled.union(told), "visual_id").join(bound, "visual_id")


def best_kpi_names(v: Views, of: DataFrame | None = None) -> DataFrame:
    """(tbl, field, label, source) of each measure: titles before captions above or left of a visual before others, then by distance."""
    rank = F.when(F.col("source") == "visual-title", 0).when(F.col("source") == "caption-near", 2).otherwise(1)
    order = Window.partitionBy("tbl", "field").orderBy(rank, F.coalesce("distance", F.lit(0)), "ord")
    return kpi_names(v, of).withColumn("rank", F.row_number().over(order)).where("rank = 1").select("tbl", "field", "label", "source")


def excluded_visuals(v: Views) -> DataFrame:
    """(page, type, n) of the visuals of a page that are no KPIs: of a type that shows none, or without a measure."""
    measured = v.get("dv_refs").where("kind = 'measure'").select("visual_id", F.lit(True).alias("measured")).distinct()
    left = v.get("dv_visuals").join(measured, "visual_id", "left").where(F.col("type").isin(*NOT_KPI) | F.col("type").rlike("(?i)slicer|filter|navigator|button") | F.col("measured").isNull())
    return left.groupBy("page", "type").agg(F.count(F.lit(1)).alias("n"))


# --- the same for DuckDB --------------------------------------------------------

_RAW_CALLS = r"(SELECT DISTINCT name, ref FROM (SELECT name, unnest(regexp_extract_all(expression, '(^|[^\w\x27\]])\[([^\]\r\n]+)\]', 2)) AS ref FROM m) WHERE ref IN (SELECT name FROM m))"
_REACHED = f"(WITH RECURSIVE p AS (SELECT name, ref AS reached FROM {_RAW_CALLS} UNION SELECT p.name, c.ref FROM p JOIN {_RAW_CALLS} c ON c.name = p.reached) SELECT * FROM p WHERE name <> reached)"


def closure_sql(mentions_sql: str) -> str:
    return f"(SELECT ord, name, tbl, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM {mentions_sql} UNION ALL SELECT m.ord, m.name, x.tbl, x.n FROM m JOIN {_REACHED} p ON p.name = m.name JOIN {mentions_sql} x ON x.name = p.reached AND x.ord = (SELECT max(ord) FROM m q WHERE q.name = p.reached)) GROUP BY ord, name, tbl)"


def primary_sql(mentions_sql: str) -> str:
    ranked = f"(SELECT *, row_number() OVER w AS place, lead(n) OVER w AS second FROM {closure_sql(mentions_sql)} WINDOW w AS (PARTITION BY ord ORDER BY n DESC, tbl))"
    return f"(SELECT m.ord, m.name, m.tbl AS home, CASE WHEN second IS NULL OR k.n >= second * 1.5 THEN k.tbl END AS primary_table, CASE WHEN k.n IS NULL THEN 'none' WHEN second IS NOT NULL AND k.n < second * 1.5 THEN 'low' WHEN EXISTS (SELECT 1 FROM {mentions_sql} d WHERE d.ord = m.ord AND d.tbl = k.tbl) THEN 'high' ELSE 'medium' END AS confidence, k.n, second FROM m LEFT JOIN {ranked} k ON k.ord = m.ord AND place = 1)"


_clean = r"CASE WHEN length(trim(regexp_replace({0}, '\s+', ' ', 'g'))) BETWEEN 1 AND 60 THEN nullif(rtrim(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), ':$', '')), '') END".format
KPI_SQL = f"""(WITH k AS (SELECT ord, page, visual_id, type, x, y, width, height, {_clean('title')} AS title, {_clean('text')} AS label FROM v), b AS (SELECT visual_id, field, tbl FROM rf WHERE kind = 'measure'),
d AS (SELECT k.visual_id, c.label, c.ord AS c_ord, CASE WHEN c.x < k.x + k.width AND k.x < c.x + c.width AND c.y + c.height <= k.y + 8 AND k.y - c.y - c.height <= 120 THEN k.y - c.y - c.height END AS up,
  CASE WHEN c.y < k.y + k.height AND k.y < c.y + c.height AND c.x + c.width <= k.x + 8 AND k.x - c.x - c.width <= 120 THEN k.x - c.x - c.width END AS side, sqrt(pow(c.x + c.width / 2 - k.x - k.width / 2, 2) + pow(c.y + c.height / 2 - k.y - k.height / 2, 2)) AS dist
  FROM k JOIN k c ON c.page = k.page AND c.type = 'textbox' AND c.label IS NOT NULL WHERE k.title IS NULL AND (SELECT count(*) FROM b WHERE b.visual_id = k.visual_id) = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY visual_id ORDER BY tier, far, c_ord) AS place FROM (SELECT *, CASE WHEN up IS NOT NULL THEN 0 WHEN side IS NOT NULL THEN 1 ELSE 2 END AS tier, coalesce(up, side, dist) AS far FROM d WHERE up IS NOT NULL OR side IS NOT NULL OR dist <= 320)),
f AS (SELECT visual_id, title AS label, 'visual-title' AS source, CAST(NULL AS BIGINT) AS distance FROM k WHERE title IS NOT NULL UNION ALL SELECT visual_id, label, ['caption-above', 'caption-left', 'caption-near'][tier + 1], CAST(floor(far + 0.5) AS BIGINT) FROM e WHERE place = 1)
SELECT k.visual_id, k.ord, k.page, f.label, f.source, f.distance, b.field, b.tbl FROM k JOIN f USING (visual_id) JOIN b USING (visual_id))"""
