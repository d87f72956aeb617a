"""Mixing sources to target weights: whole epochs first, then Efraimidis-Spirakis sampling without replacement.

A document's key is -ln(u) / w, u a uniform number fixed by seed and doc_id, w its quality weight: ascending keys are a
weighted sample without replacement. What a source's target leaves after whole epochs is taken along that order until the
budget is full; the document across the edge gives its first words.

The order is never sorted as a whole. Keys are folded into BUCKETS of about equal weight; sums per (source, bucket),
combined before the shuffle, tell the one bucket where each budget ends, and only that bucket's rows are sorted. A source
with a third of all rows costs a window over its third / BUCKETS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, numbered, only, prepare, staged, unused

BUCKETS = 4096
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def quality(text: str = "text") -> F.Column:
    """A weight in 0.05..1 that falls with the share of signs other than letters and white space."""
    share = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\p{L}\p{M}\x20\x09-\x0D]")) / F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * share)


def targets(sources: DataFrame) -> DataFrame:
    """`sources` (source, source_size) with its target: shares of all sizes by weight, none over REPEATS times its size.

    Capped sources are a prefix in the order of size / weight, so sums over that order tell them without iteration. One
    row per source goes through one task: a catalogue, not data.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    s = sources.withColumn("weight", weight).withColumns({"cap": F.col("source_size") * REPEATS, "all": F.sum("source_size").over(all_rows), "weights": F.sum("weight").over(all_rows)})
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"before": F.coalesce(F.sum("cap").over(order), F.lit(0)), "used": F.coalesce(F.sum("weight").over(order), F.lit(0))})
    s = s.withColumn("full", F.expr("cap * (weights - used) <= weight * (all - before)"))
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_rows), F.lit(0))
    among = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_rows), F.lit(0))
    s = s.withColumns({"left": left, "among": among})
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("left")).cast("double") / F.col("among")).alias("target"))


def mix(docs: DataFrame, weight: F.Column | None = None, seed: str = "0", row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the row that the mix takes), epochs and part of every row of `docs`.

    `docs` has doc_id, source and text; `weight` is a positive quality weight over its columns (1 if absent, 0.05 if null
    or less). taken = epochs * size + part. A null or empty text has size 0 and gives nothing. Sources go by code point,
    null last, and weigh 5, 2, 1, repeating. Ties in keys go by doc_id, nulls first, then by size and a hash of the text; rows
    that repeat an id stand beside each other, each with its own `taken`, and only equal rows are interchangeable. Other columns are ignored; an empty table gives an empty result.

    `row` names a column of `docs` that tells rows apart. It then comes back too and breaks the ties that ids leave, and
    rows without an id draw their number by text, so that they don't stand or fall together.
    """
    prepare(docs.sparkSession)
    name = F.col("doc_id").cast("string")
    name = F.coalesce(name, F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))) if row else F.coalesce(name, F.lit(""))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double")
    w = F.greatest(F.lit(0.05), F.coalesce(weight.cast("double"), F.lit(0.05))) if weight is not None else F.lit(1.0)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), (-F.log((unit + 0.5) / float(1 << 52)) / w).alias("key"), w.alias("weight"), F.xxhash64("text").alias("tie"), *([F.col(row).alias("row")] if row else []))
    rows = staged(rows, "mix")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("weight").alias("mean"))
    sums = staged(sums, "sources")
    plan = targets(sums.select("source", "source_size")).alias("t").join(sums.alias("s"), F.expr("t.source <=> s.source")).select("t.*", "s.mean")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = staged(plan, "plan")
    small = bounded(plan.withColumnRenamed("source", "of"))
    placed = rows.join(small, F.expr("source <=> of")).withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.col("mean"))) * (BUCKETS - 1)).cast("int"))
    heaps = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = heaps.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).where("before <= budget AND budget < before + words")
    edges = bounded(staged(edges.select(F.col("source").alias("at"), F.col("bucket").alias("edge"), "before"), "edges"))
    cut = placed.join(edges, F.expr("source <=> at"), "left")
    shape = ["doc_id", "size", "source_size", "target", F.expr("epochs * size + part").alias("taken"), "epochs", "part", "source", *(["row"] if row else [])]
    # a budget that no bucket's end lies beyond takes everything
    whole = cut.where("edge IS NULL OR bucket <> edge").withColumn("part", F.when(F.expr("budget = 0"), 0).when(F.expr("edge IS NULL OR bucket < edge"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    within = Window.partitionBy("source").orderBy("key", "doc_id", "size", "tie", *(["row"] if row else [])).rowsBetween(Window.unboundedPreceding, -1)
    sorted_rows = cut.where("bucket = edge").withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("part", F.expr("least(size, greatest(0L, budget - before - inside))"))
    return whole.select(*shape).union(sorted_rows.select(*shape))


def mixed_documents(docs: DataFrame, weight: F.Column | None = None, seed: str = "0") -> DataFrame:
    """The mix itself: the rows of `docs` (with their columns) as often as taken, the one across the edge cut to its first words.

    Rows meet their counts by row, not by doc_id: ids may be null or repeated. n_chars, if there, is that of the text as it
    goes out. Other columns, whatever their names, go out as they are. An empty table gives an empty result.
    """
    number = unused("row_of_docs", docs.columns)
    rows = numbered(docs, number)
    counted = staged(mix(rows, weight, seed, number).select("row", "size", "epochs", "part").where("epochs > 0 OR part > 0"), "taken")
    # a document's own columns stand in a struct, so that none of their names meets those of the counts
    held = rows.select(F.col(number).alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    copies = held.join(bounded(counted), "row").withColumn("copy", F.explode(F.expr("sequence(1, cast(epochs + if(part > 0, 1, 0) as int))")))
    cut = F.expr("copy > epochs AND part < size")
    # word by word: a counted group would recurse once a word
    first = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0)), F.lit(1), F.col("part").cast("int")), "")
    copies = copies.withColumn("cut", F.when(cut, first))
    new = {"text": F.coalesce("cut", "doc.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("cut").cast(docs.schema["n_chars"].dataType), "doc.n_chars")
    return copies.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
