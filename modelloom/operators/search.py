"""Lists and search over the model's frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attribution
from .model_rules import Views


def _any(label: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(label), F.lit(w.lower())) for w in words))


def found(v: Views, words: list[str], n: int = 12) -> DataFrame:
    """(kind, label): the first `n` tables, then measures, then pages whose name holds one of the words, whatever its case."""
    labels = v.get("dv_tables").select(F.lit(1).alias("k"), F.lit("table").alias("kind"), F.col("name").alias("label"), "ord")
    labels = labels.union(v.get("dv_measures").select(F.lit(2), F.lit("measure"), "name", "ord")).union(v.get("dv_pages").select(F.lit(3), F.lit("page"), "display_name", "ord"))
    return labels.where(_any(F.col("label"), words)).orderBy("k", "ord").limit(n).select("kind", "label")


def measures_with(v: Views, words: list[str]) -> DataFrame:
    """(ord, name) of the measures whose name, table, expression or best caption holds one of the words."""
    best = attribution.best_kpi_names(v).select("tbl", F.col("field").alias("name"), "label")
    return v.get("dv_measures").join(best, ["tbl", "name"], "left").where(_any(F.concat_ws(" ", "name", "tbl", "expression", "label"), words)).select("ord", "name")


def query_list(v: Views) -> DataFrame:
    """(tbl, name, kind): native partitions before folded ones, then by table."""
    kind = F.when(F.col("connector") == "Odbc.DataSource", "folded").otherwise("native")
    return v.get("dv_partitions").select("tbl", "name", kind.alias("kind")).orderBy(F.col("kind") != "native", "tbl", "name")


def sections(v: Views) -> DataFrame:
    """(name, section): where documentation puts each measure: under its primary table, with those of several tables, or unmapped."""
    section = F.when(F.col("primary_table").isNotNull(), "table").when(F.col("confidence") == "low", "several tables").otherwise("unmapped")
    return attribution.primary_tables(v).select("name", section.alias("section"))
