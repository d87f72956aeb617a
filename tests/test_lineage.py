"""Lineage of a small model: every kind of node and edge, what is left out, and the part around one node."""

from modelloom.operators import lineage
from modelloom.operators.model_rules import Views

MEASURES = [
    (1, "Facts", "Unique Sales", "DIVIDE ( [Order Count], 2 )", None), (2, "Facts", "Order Count", "COUNTROWS ( Orders ) -- [Total Revenue]", None), (3, "Facts", "Total Revenue", "SUM ( Orders[Amount] )", None),
    (4, "Facts", "Unused", "[Total Revenue]", None), (5, "Other", "Qualified", "Facts[Order Count] + [Qualified]", None), (6, "Other", "Total Revenue", "1", None),
]
VISUALS = [(1, "p1", "v1", "card", "Sales Card", None), (2, "p1", "v2", "card", None, None), (3, "p1", "v3", "slicer", None, None), (4, "p2", "v4", "card", None, None), (5, "p2", "v5", "textbox", None, "Some words"), (6, "p2", "v6", "mySlicerVisual", None, None)]
REFS = [
    (1, "p1", "v1", "card", 0, "Facts", "Unique Sales", "measure"), (2, "p1", "v2", "card", 0, None, "Total Revenue", "measure"), (2, "p1", "v2", "card", 1, "Orders", "Amount", "column"), (2, "p1", "v2", "card", 2, "Facts", "Absent", "measure"),
    (3, "p1", "v3", "slicer", 0, "Facts", "Unused", "measure"), (4, "p2", "v4", "card", 0, "Other", "Qualified", "measure"), (4, "p2", "v4", "card", 1, "Nowhere", "Unique Sales", "measure"), (6, "p2", "v6", "mySlicerVisual", 0, "Facts", "Unused", "measure"),
]
PARTITIONS = [(2, "Orders", "SELECT a FROM [an].[orders] o JOIN x ON 1=1", "Sql.Database"), (1, "Orders", "SELECT a -- FROM no\n FROM analytics.orders WHERE n = 'FROM y'", "Sql.Database"), (0, "Orders", "SELECT folded FROM z", "Odbc.DataSource")]


class _Small(Views):
    def __init__(self, spark, measures=MEASURES):
        frames = {
            "dv_measures": (measures, "ord long, tbl string, name string, expression string, title string"), "dv_visuals": ([(*v, 10.0 * v[0], 900.0 * v[0], 5.0, 5.0) for v in VISUALS], "ord long, page string, visual_id string, type string, title string, text string, x double, y double, width double, height double"),
            "dv_refs": (REFS, "ord long, page string, visual_id string, type string, ref_ord int, tbl string, field string, kind string"), "dv_tables": ([(1, "Orders"), (2, "Facts")], "ord long, name string"),
            "dv_partitions": (PARTITIONS, "ord long, tbl string, statement string, connector string"),
        }
        self.get = lambda name: spark.createDataFrame(*frames[name])


def test_edges(spark):
    m = lambda t, n: f"measure:{t}[{n}]"
    got = {(r.src, r.dst, r.kind) for r in lineage.edges(_Small(spark)).collect()}
    assert got == {
        (m("Facts", "Unique Sales"), "visual:p1/v1", "displays"), (m("Other", "Total Revenue"), "visual:p1/v2", "displays"), (m("Other", "Qualified"), "visual:p2/v4", "displays"), (m("Facts", "Unique Sales"), "visual:p2/v4", "displays"),
        ("visual:p1/v1", "kpi:sales card", "reports"), ("visual:p1/v2", "kpi:total revenue", "reports"), ("visual:p2/v4", "kpi:qualified", "reports"),
        (m("Facts", "Order Count"), m("Facts", "Unique Sales"), "calls"), (m("Facts", "Order Count"), m("Other", "Qualified"), "calls"), (m("Other", "Total Revenue"), m("Facts", "Order Count"), "calls"),
        ("table:Orders", m("Facts", "Order Count"), "feeds"), ("table:Facts", m("Other", "Qualified"), "feeds"), ("source:analytics.orders", "table:Orders", "loads"),
        ("kpi:qualified", "kpi:sales card", "related"),
    }
    page = {(r.src, r.dst, r.kind, r.about) for r in lineage.edges(_Small(spark), "p2").collect()}
    assert ("visual:p2/v4", "kpi:qualified", "reports", "Qualified") in page and not any("visual:p1/" in dst for _, dst, *_ in page)


def test_related_by_a_direct_call(spark):
    measures = [(*m[:3], "[Total Revenue] * 2", None) if m[0] == 1 else m for m in MEASURES]
    got = {(r.src, r.dst): r.about for r in lineage.edges(_Small(spark, measures)).where("kind = 'related'").collect()}
    assert got[("kpi:sales card", "kpi:total revenue")] == "Total Revenue" and got[("kpi:qualified", "kpi:sales card")] == "Unique Sales"


def test_around_a_node(spark):
    edges = spark.createDataFrame([("s", "t"), ("t", "m"), ("m", "v"), ("v", "k"), ("x", "v"), ("q", "t"), ("k", "m"), ("z", "k"), ("far", "z")], "src string, dst string")
    # what reaches k is passed only from outside of what m reaches
    assert {r.node for r in lineage.connected(edges, "m").collect()} == {"m", "v", "k", "t", "s", "q"}
    assert {r.node for r in lineage.connected(edges, "v").collect()} == {"v", "k", "m", "x"}
    assert {r.node for r in lineage.connected(edges, "nobody").collect()} == {"nobody"}


def test_objects_of_statements(spark):
    rows = [(1, "A", "SELECT 1 FROM \"a\".b", "Sql.Database"), (1, "B", "SELECT 1", "Sql.Database"), (1, "C", "SELECT x FROM c", "Odbc.DataSource")]
    got = {r.tbl: r.object for r in lineage.source_objects(spark.createDataFrame(rows, "ord long, tbl string, statement string, connector string")).collect()}
    assert got == {"A": '"a".b'}


def test_related_kpis_need_no_tables(spark, monkeypatch):
    want = {tuple(r) for r in lineage.edges(_Small(spark)).where("kind = 'related'").collect()}
    monkeypatch.setattr(lineage, "mentions", None)
    assert {tuple(r) for r in lineage.related(_Small(spark)).collect()} == want != set()


def test_expressions_are_not_aggregated(spark):
    plan = lineage.measures_by_key(Views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_captions_for_few_measures(spark):
    on = lineage.shown(_Small(spark), "p1")
    told = [{tuple(r) for r in lineage.kpis(_Small(spark), on, few).collect()} for few in (False, True)]
    assert told[0] == told[1] and ("visual:p1/v1", "kpi:sales card", "Sales Card") in told[1]
