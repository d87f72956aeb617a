"""Secrets in texts: a trigram index names the rows that a rule may match, and only these are searched for it.

Rules whose pattern has no mandatory trigram search all texts. All of it is native: nothing runs in Python workers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, prepare, staged
from .trigrams import ANY, candidates, placed, postings, trigram_query


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and without overlap; those whose `group` has fewer than `least` signs are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: A run of hexadecimal signs, or of signs after AKIA, is as long as it can be, so its least length may stand in the pattern.
BASE = [
    Rule("assign", rf"""({_any_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
]
#: How well-known services mark their keys.
FURTHER = [
    Rule("pem", "-----BEGIN (?:[A-Z]+ ){0,4}PRIVATE KEY-----"),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
RULES = BASE + FURTHER


def _matches(rule: Rule, place: int) -> Column:
    """array<struct<place, gap, n, long>>: for each match the signs between it and the one before, its own, and whether it is long
    enough; what lies behind the last match has no n. The text is cut once for all matches."""
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    cut = F.arrays_zip(F.split("text", rule.pattern, -1), found, group)
    each = F.transform(cut, lambda x: F.struct(F.lit(place).alias("place"), F.length(x["0"]).alias("gap"), F.length(x["1"]).alias("n"), (F.length(x["2"]) >= rule.least).alias("long")))
    return F.when(F.col("text").rlike(rule.pattern), each)


def _located(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """(file, row, place, start, end) of the long matches, in code points: a running sum over a text's own matches."""
    each = rows.select("file", "row", F.explode(F.array_compact(F.array(*columns))).alias("of_rule")).select("file", "row", F.posexplode("of_rule").alias("i", "m")).select("file", "row", "i", "m.*").where("n IS NOT NULL")
    upto = Window.partitionBy("file", "row", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ended = each.withColumn("end", F.sum(F.expr("CAST(gap + n AS BIGINT)")).over(upto))
    return ended.where("long").select("file", "row", "place", F.expr("end - n").alias("start"), "end")


def _spans(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ANY}
    everywhere = [_matches(r, i) for i, r in enumerate(rules) if r.kind not in indexed]
    found = [_located(rows, everywhere)] if everywhere else []
    if indexed:
        index = staged(postings(rows, sorted(set().union(*(b for q in indexed.values() for b in q)))), "trigram_index")
        maybe = bounded(staged(candidates(index, indexed), "candidates"))
        verified = [F.when(F.array_contains("kinds", F.lit(r.kind)), _matches(r, i)) for i, r in enumerate(rules) if r.kind in indexed]
        found.append(_located(rows.join(maybe, ["file", "row"]), verified))
    return found[0] if len(found) == 1 else found[0].union(found[1])


def secret_spans(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, kind, start, end) of every span of `rules` in the whole texts of `docs` (doc_id, text, ...), as in `scan`."""
    prepare(docs.sparkSession)
    rows = placed(docs)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return rows.select("file", "row", "doc_id").join(_spans(rows, rules), ["file", "row"]).select("doc_id", F.get(kinds, F.col("place")).alias("kind"), "start", "end")


def scan(docs: DataFrame, rules: list[Rule] = RULES, base: int = len(BASE)) -> DataFrame:
    """doc_id, n_<kind> for the first `base` rules, base_sha256 and spans for every row of `docs` (doc_id, text, ...).

    Positions count code points from 0, ends are exclusive. Spans read kind:start:end, by start, then in the order of the
    rules, joined by commas; base_sha256 is the digest of the first `base` rules' spans alone. Null text is empty; texts of any
    length are searched whole. Rows are told apart by their place, so null and repeated ids and repeated rows come
    back as often as given. Other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = placed(docs)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    told = lambda x: F.concat_ws(":", F.get(kinds, x["place"]), x["start"].cast("string"), x["end"].cast("string"))
    of = lambda place: F.size(F.filter("base", lambda x: x["place"] == place)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, told), ",")
    # one text's own spans
    per_row = _spans(rows, rules).groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("start", "place", "end"))).alias("all"))
    per_row = per_row.withColumn("base", F.filter("all", lambda x: x["place"] < base))
    per_row = staged(per_row.select("file", "row", *(of(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])), F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans")), "spans")
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).alias(f"n_{r.kind}") for r in rules[:base]]
    return rows.select("file", "row", "doc_id").join(bounded(per_row), ["file", "row"], "left").select("doc_id", *counts, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
