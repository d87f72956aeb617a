"""Findings as a whole: ids, order, which rules ran, scores of categories and of all, and what a reviewer has decided."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import model_rules
from .model_rules import Views
from .rules import QA, findings
from .scoring import category_scores

#: Severities, worst first, and the categories in their order.
SEVERITIES = ["critical", "high", "medium", "low"]
CATEGORIES = ["DAX", "Model", "Relationship", "Report", "Data"]
#: Rules that tell whether references hold.
INTEGRITY = ["REP-BROKEN-FIELD", "DQ-MEASURE-MISSING-DEPENDENCY", "DQ-RELATIONSHIP-TYPE-MISMATCH"]


def catalogue() -> list[tuple[str, str, list[str]]]:
    """(rule, category, capabilities it needs) of all QA rules."""
    joined = [(r, c) for name in model_rules.RULES if name.startswith("qa_") for r, c in [_of(name)]]
    needs = lambda rule: ["model", "report"] if rule == "REP-BROKEN-FIELD" else ["report"] if rule.startswith("REP-") else ["model"]
    return [(r, c, needs(r)) for r, c in [(r.id, r.category) for r in QA] + joined]


def _of(name: str) -> tuple[str, str]:
    head = model_rules.SQL[name].split("'")
    return head[1], head[3]


def qa_findings(v: Views) -> DataFrame:
    """The findings of all QA rules: those over one frame in one pass, and those that join or group frames, which are derived once for all."""
    v = v.shared()
    hits = findings(v.measures(), QA, "name")
    for name, rule in model_rules.RULES.items():
        if name.startswith("qa_"):
            hits = hits.unionByName(rule(v))
    return hits


def identified(hits: DataFrame) -> DataFrame:
    """Findings with finding_id: the rule, the target and the hit's number among those of the rule and target.

    Numbers are per target, so that no window holds all of a rule's hits."""
    order = Window.partitionBy("rule_id", "target").orderBy("severity")
    return hits.withColumn("finding_id", F.concat_ws("#", "rule_id", "target", F.row_number().over(order) - 1))


def ranked(hits: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return hits.withColumn("severity_rank", rank.cast("int"))


def top_problems(v: Views, n: int = 5) -> DataFrame:
    """The first `n` findings by severity, category and target: kept as a heap per task, no sort of all."""
    return ranked(qa_findings(v)).orderBy("severity_rank", "category", "target", "rule_id").limit(n)


def severities(hits: DataFrame) -> DataFrame:
    domain = hits.sparkSession.createDataFrame([(x,) for x in SEVERITIES], "severity string")
    n = hits.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(n, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def capabilities(found: DataFrame) -> DataFrame:
    """(file, capability, available, reason) of each file of `found` (file, model_part, layout_part): what its parts let be read."""
    each = F.array(*(F.struct(F.lit(c).alias("capability"), F.col(part).isNotNull().alias("available"), F.lit(f"No {c} part.").alias("reason")) for c, part in (("model", "model_part"), ("report", "layout_part"))))
    return found.select("file", F.explode(each).alias("c")).select("file", "c.*")


def rules_run(available: DataFrame) -> DataFrame:
    """(file, category, rules_run, rules_skipped, reason): `available` (file, capability, available, reason) decides which rules run; the
    first lacking capability of a category's first skipped rule gives the reason."""
    needed = [(i, r, c, j, cap) for i, (r, c, caps) in enumerate(catalogue()) for j, cap in enumerate(caps)]
    # a row for each rule and capability: a catalogue, so the side is broadcast
    rules = F.broadcast(available.sparkSession.createDataFrame(needed, "place int, rule_id string, category string, need int, capability string"))
    of_rule = available.join(rules, "capability").groupBy("file", "place", "category").agg(F.min_by("reason", F.when(~F.col("available"), F.col("need"))).alias("reason"))
    skipped = F.col("reason").isNotNull()
    return of_rule.groupBy("file", "category").agg(F.count_if(~skipped).alias("rules_run"), F.count_if(skipped).alias("rules_skipped"), F.min_by("reason", F.when(skipped, F.col("place"))).alias("reason"))


def populations(v: Views) -> DataFrame:
    """(category, population): how many objects each category looks at."""
    sizes = [v.get(name).agg(F.count(F.lit(1)).alias(name)) for name in ("dv_measures", "dv_tables", "dv_relations", "dv_pages")]
    one = sizes[0]
    for other in sizes[1:]:
        # one row each
        one = one.join(F.broadcast(other))
    sums = {"DAX": "dv_measures", "Model": "dv_measures + dv_tables", "Relationship": "dv_relations", "Report": "dv_pages", "Data": "dv_measures + dv_relations"}
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.expr(e).cast("bigint").alias("population")) for c, e in sums.items()))).alias("p")).select("p.*")


def scores(v: Views) -> DataFrame:
    return category_scores(qa_findings(v), populations(v))


def overall(v: Views) -> DataFrame:
    """The mean of the categories that have a score, rounded half up; null if none has."""
    return scores(v).agg(F.floor(F.avg("score") + 0.5).cast("bigint").alias("overall"))


def inbox(hits: DataFrame, triage: DataFrame) -> DataFrame:
    """(severity, outstanding, flagged, resolved, ignored): `triage` (finding_id, state) says what was decided; without it a finding is open."""
    state = hits.join(triage, "finding_id", "left").withColumn("state", F.coalesce("state", F.lit("open")))
    counted = state.groupBy("severity").agg(F.count_if(F.col("state").isin("open", "flagged")).alias("outstanding"), *(F.count_if(F.col("state") == x).alias(x) for x in ("flagged", "resolved", "ignored")))
    domain = hits.sparkSession.createDataFrame([(x,) for x in SEVERITIES], "severity string")
    return domain.join(counted, "severity", "left").fillna(0)


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of the integrity rules that `after` has and `before` has not, by their ids."""
    of = lambda hits: hits.where(F.col("rule_id").isin(*INTEGRITY))
    return of(after).join(of(before).select("finding_id"), "finding_id", "left_anti")
