"""Edits and versions as rows: what a rename runs into and touches, what an export lost, which versions stay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .model_rules import Views


def collisions(v: Views) -> DataFrame:
    """(change_id, clash): renames to a name that is taken: a measure's anywhere, a table's in the model, a column's in its table."""
    renames = v.get("dv_changes").where("field = 'name'")
    measures = renames.where("target_type = 'measure'").join(v.get("dv_measures").select(F.col("name").alias("after"), F.col("tbl").alias("clash_tbl")).distinct(), "after").where("NOT (after = name AND clash_tbl = tbl)")
    tables = renames.where("target_type = 'table'").join(v.get("dv_tables").select(F.col("name").alias("after")).distinct(), "after")
    columns = renames.where("target_type = 'column'").join(v.get("dv_columns").select("tbl", F.col("name").alias("after")).distinct(), ["tbl", "after"])
    return measures.select("change_id", F.lit("measure").alias("clash")).union(tables.select("change_id", F.lit("table"))).union(columns.select("change_id", F.lit("column")))


def previews(v: Views) -> DataFrame:
    """(change_id, pages, visuals, measures) that the rename of a measure touches: bindings by its name, expressions that name it in brackets."""
    renames = v.get("dv_changes").where("field = 'name' AND target_type = 'measure'").select("change_id", F.col("name"))
    bound = v.get("dv_refs").where("kind = 'measure'").groupBy(F.col("field").alias("name")).agg(F.count_distinct("page").alias("pages"), F.count_distinct("page", "visual_id").alias("visuals"))
    named = v.get("dv_measures").select(F.col("name").alias("by"), F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(r"\[([^\]\r\n]+)\]"), F.lit(1)))).alias("name"))
    named = named.where("by <> name").groupBy("name").agg(F.count(F.lit(1)).alias("measures"))
    return renames.join(bound, "name", "left").join(named, "name", "left").fillna(0, ["pages", "visuals", "measures"]).drop("name")


def audit(expected: DataFrame, actual: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """(*key, problem): what is missing, extra or differs in a compared column between two frames with one row a key."""
    a, b = expected.select(*key, F.struct(*compared).alias("want"), F.lit(True).alias("in_a")), actual.select(*key, F.struct(*compared).alias("got"), F.lit(True).alias("in_b"))
    problem = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("want").eqNullSafe(F.col("got")), "differs")
    return a.join(b, key, "full_outer").select(*key, problem.alias("problem")).where("problem IS NOT NULL")


def measure_audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """As `audit`, for measures (tbl, name, expression); expressions that differ in white space only are equal."""
    plain = lambda df: df.select("tbl", "name", text.squeezed(F.col("expression")).alias("expression"))
    return audit(plain(expected), plain(actual), ["tbl", "name"], ["expression"])


#: What an audit compares: the frame of each check, what tells an object and what must be the same. Expressions may be laid out anew.
CHECKS = {
    "tables": ("tables", ["name"], ["description", "is_hidden"]), "columns": ("columns", ["tbl", "name"], ["data_type", "kind"]), "measures": ("measures", ["tbl", "name"], ["expression"]), "formats": ("measures", ["tbl", "name"], ["format_string"]),
    "relations": ("relations", ["a", "column_a", "b", "column_b"], ["from_many", "to_many", "both_directions", "active"]), "partitions": ("partitions", ["tbl", "name"], ["source_type"]), "statements": ("partitions", ["tbl", "name"], ["statement"]),
    "pages": ("pages", ["page"], ["display_name", "is_hidden"]), "visuals": ("visuals", ["page", "visual_id"], ["type"]), "titles": ("visuals", ["page", "visual_id"], ["title"]), "bindings": ("refs", ["page", "visual_id", "ref_ord"], ["kind", "tbl", "field"]),
}
LAID_OUT = ["expression", "statement"]


def objects(v: Views, prefix: str) -> DataFrame:
    """(check, key, value): every object of the model's frames for each check, in one shape."""
    frames: list[DataFrame] = []
    for check, (frame, key, compared) in CHECKS.items():
        joined = lambda names: F.concat_ws("\x1f", *(F.coalesce(text.squeezed(F.col(c)) if c in LAID_OUT else F.col(c).cast("string"), F.lit("\x1e")) for c in names))
        frames.append(v.get(f"{prefix}_{frame}").select(F.lit(check).alias("check"), joined(key).alias("key"), joined(compared).alias("value")))
    return reduce(DataFrame.union, frames)


def model_audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(check, objects, missing, extra, differs, first, passed), a row for each check with an object on either side.

    Both sides are tagged and met in one grouping by check and key, then counted; objects that share a key are compared as a set.
    `first` is the smallest key with a problem."""
    tagged = expected.withColumn("side", F.lit("a")).union(actual.withColumn("side", F.lit("b")))
    of = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("value"))))
    met = tagged.groupBy("check", "key").agg(of("a").alias("a"), of("b").alias("b"))
    problem = F.when(F.size("b") == 0, "missing").when(F.size("a") == 0, "extra").when(F.col("a") != F.col("b"), "differs")
    told = met.withColumn("problem", problem)
    counted = told.groupBy("check").agg(F.count_if(F.size("a") > 0).alias("objects"), *(F.count_if(F.col("problem") == x).alias(x) for x in ("missing", "extra", "differs")), F.min(F.when(F.col("problem").isNotNull(), F.replace(F.replace("key", F.lit("\x1f"), F.lit("/")), F.lit("\x1e"), F.lit("")))).alias("first"))
    return counted.withColumn("passed", F.col("first").isNull())


def audit_sql() -> str:
    """The same for DuckDB: a full join of the two sides for each check."""
    parts = []
    for check, (frame, key, compared) in CHECKS.items():
        as_text = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))" if c in LAID_OUT else f"CAST({c} AS VARCHAR)"
        side = lambda p: f"(SELECT {', '.join(f'{c} AS k{i}' for i, c in enumerate(key))}, list_sort(list(DISTINCT [{', '.join(map(as_text, compared))}])) AS v FROM {p}{frame} GROUP BY ALL)"
        on = " AND ".join(f"x.k{i} IS NOT DISTINCT FROM y.k{i}" for i in range(len(key)))
        told = " || '/' || ".join(f"coalesce(CAST(coalesce(x.k{i}, y.k{i}) AS VARCHAR), '')" for i in range(len(key)))
        parts.append(f"SELECT '{check}' AS \"check\", {told} AS k, x.v IS NOT NULL AS here, CASE WHEN y.v IS NULL THEN 'missing' WHEN x.v IS NULL THEN 'extra' WHEN x.v <> y.v THEN 'differs' END AS problem FROM {side('of_')} x FULL JOIN {side('by_')} y ON {on}")
    return f"""SELECT "check", count(*) FILTER (WHERE here) AS objects, count(*) FILTER (WHERE problem = 'missing') AS missing, count(*) FILTER (WHERE problem = 'extra') AS extra, count(*) FILTER (WHERE problem = 'differs') AS differs, min(k) FILTER (WHERE problem IS NOT NULL) AS first, count(problem) = 0 AS passed FROM ({' UNION ALL '.join(parts)}) GROUP BY "check\""""


def latest_per_target(v: Views) -> DataFrame:
    """The last change of each file, target and field: what a replay of the session ends in."""
    keys = ["file", "target_type", "tbl", "name", "field"]
    return v.get("dv_changes").groupBy(*keys).agg(F.max_by(F.struct("seq", "change_id", "after"), "seq").alias("c"), F.count(F.lit(1)).alias("changes")).select(*keys, "c.*", "changes")


def versions(records: DataFrame, keep: int = 25) -> DataFrame:
    """Of `records` (sha256, created, name) the newest of each sha256, and of those the `keep` newest."""
    newest = Window.partitionBy("sha256").orderBy(F.desc("created"))
    return records.withColumn("place", F.row_number().over(newest)).where("place = 1").drop("place").orderBy(F.desc("created"), "sha256").limit(keep)
