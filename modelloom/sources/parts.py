"""Parts of project files as rows (file, part, place, bytes): format detection, decoding and parsing in native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a model document is read into; whatever else it holds is ignored.
MODEL = "struct<tables: array<struct<name: string, columns: array<struct<name: string, dataType: string, type: string>>, measures: array<struct<name: string, expression: variant, formatString: string, isHidden: boolean>>>>>"


def canonical(part: Column) -> Column:
    """Part names are told without leading slashes and in lower case."""
    return F.lower(F.regexp_replace(part, "^/+", ""))


def detected(parts: DataFrame) -> DataFrame:
    """(file, format, model_part, layout_part): by the names of a file's parts alone; of several fitting parts the first.

    Rules in order: DataModelSchema makes a pbit; a model.bim, TMDL text or report.json a pbip; DataModel a pbix; else no row."""
    name = canonical(F.col("part"))
    first = lambda test: F.min_by("part", F.when(test, F.col("place")))
    bim = F.col("part").endswith(".SemanticModel/model.bim") | (F.col("part") == "model.bim")
    tmdl = F.col("part").contains(".SemanticModel/definition/") & F.col("part").endswith(".tmdl")
    found = parts.groupBy("file").agg(
        first(name == "datamodelschema").alias("schema"), first(bim).alias("bim"), first(tmdl).alias("tmdl"), first(F.col("part").endswith(".Report/report.json")).alias("own"), first(F.col("part") == "report.json").alias("bare"),
        first(name == "datamodel").alias("binary"), first(name == "report/layout").alias("layout"),
    )
    kind = F.when(F.col("schema").isNotNull(), "pbit").when(F.expr("coalesce(bim, tmdl, own, bare) IS NOT NULL"), "pbip").when(F.col("binary").isNotNull(), "pbix")
    told = found.withColumn("format", kind).where("format IS NOT NULL")
    return told.select("file", "format", F.expr("CASE format WHEN 'pbit' THEN schema WHEN 'pbip' THEN bim END").alias("model_part"), F.expr("CASE format WHEN 'pbip' THEN coalesce(own, bare) ELSE layout END").alias("layout_part"))


def decoded(parts: DataFrame) -> DataFrame:
    """`parts` with text, encoding and bom: UTF-16LE first if the second byte is zero, else UTF-8 first; what parses as JSON
    counts. Parts that parse neither way have no text."""
    wide, narrow = F.decode("bytes", "UTF-16LE"), F.try_validate_utf8(F.col("bytes").cast("string"))
    whole = F.length("bytes") % 2 == 0
    tried = lambda text, name: F.when(F.try_parse_json(F.ltrim(F.regexp_replace(text, "^﻿", ""))).isNotNull(), F.struct(F.regexp_replace(text, "^﻿", "").alias("text"), F.lit(name).alias("encoding"), text.startswith("﻿").alias("bom")))
    utf16, utf8 = F.when(whole, tried(wide, "utf-16le")), tried(narrow, "utf-8")
    found = F.when(F.substring("bytes", 2, 1) == F.lit(b"\0"), F.coalesce(utf16, utf8)).otherwise(F.coalesce(utf8, utf16))
    return parts.withColumn("found", found).select(*parts.columns, "found.text", "found.encoding", "found.bom")


def encoded(text: Column, wide: Column, bom: Column) -> Column:
    """Text in its first framing again: UTF-16LE or UTF-8, with or without the byte order mark."""
    marked = F.concat(F.when(bom, F.lit("﻿")).otherwise(F.lit("")), text)
    return F.when(wide, F.encode(marked, "UTF-16LE")).otherwise(F.encode(marked, "UTF-8"))


def models(parts: DataFrame) -> DataFrame:
    """(file, part, model) of the decoded parts that hold a model: the document's `model`, or the document itself."""
    doc = F.from_json("text", f"struct<model: {MODEL}, tables: {MODEL.removeprefix('struct<tables: ').removesuffix('>')}>")
    return parts.withColumn("doc", doc).select("file", "part", F.coalesce("doc.model.tables", "doc.tables").alias("tables")).where("tables IS NOT NULL")


def joined_expression(value: Column) -> Column:
    """Of a variant: a string as it is, whatever it looks like; a list as its strings joined by line ends, null if empty."""
    lines = F.try_variant_get(value, "$", "array<string>")
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.nullif(F.array_join(lines, "\n"), F.lit(""))).otherwise(F.try_variant_get(value, "$", "string"))


def measures(found: DataFrame) -> DataFrame:
    rows = found.select("file", F.posexplode("tables").alias("place", "t")).select("file", F.col("t.name").alias("tbl"), F.posexplode("t.measures").alias("ord", "x"))
    return rows.select("file", "tbl", "ord", "x.name", joined_expression(F.col("x.expression")).alias("expression"), F.coalesce("x.isHidden", F.lit(False)).alias("is_hidden"))


def columns(found: DataFrame) -> DataFrame:
    rows = found.select("file", F.explode("tables").alias("t")).select("file", F.col("t.name").alias("tbl"), F.posexplode("t.columns").alias("ord", "x"))
    return rows.select("file", "tbl", "ord", "x.name", F.coalesce("x.dataType", F.lit("unknown")).alias("data_type"))


#: How strings of the query language escape signs; # is written first and read last.
M_ESCAPES = {"#(lf)": "\n", "#(cr)": "\r", "#(tab)": "\t"}


def encode_m(text: Column) -> Column:
    out = F.replace(text, F.lit("#"), F.lit("#(#)"))
    for escape, sign in M_ESCAPES.items():
        out = F.replace(out, F.lit(sign), F.lit(escape))
    return F.replace(out, F.lit('"'), F.lit('""'))


def decode_m(text: Column) -> Column:
    out = F.replace(text, F.lit('""'), F.lit('"'))
    for escape, sign in M_ESCAPES.items():
        out = F.replace(out, F.lit(escape), F.lit(sign))
    return F.replace(out, F.lit("#(#)"), F.lit("#"))


def coverage(parts: DataFrame) -> DataFrame:
    """(kind, property, n): how often model tables, columns and measures carry each property, from decoded parts, as variants; documents that
    are a model by themselves count too, as `models` reads them (the reference's audit looks under `model` only)."""
    tables = parts.select(F.try_parse_json("text").alias("v")).select(F.coalesce(F.try_variant_get("v", "$.model.tables", "array<variant>"), F.try_variant_get("v", "$.tables", "array<variant>")).alias("t")).select(F.explode("t").alias("t"))
    of = lambda name: tables.select(F.explode(F.try_variant_get("t", f"$.{name}", "array<variant>")).alias("t")).select(F.lit(name[:-1]).alias("kind"), "t")
    every = tables.select(F.lit("table").alias("kind"), "t").union(of("columns")).union(of("measures"))
    return every.select("kind", F.explode(F.json_object_keys(F.to_json("t"))).alias("property")).groupBy("kind", "property").agg(F.count(F.lit(1)).alias("n"))
