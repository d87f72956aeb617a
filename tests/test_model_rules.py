"""Operators over the model's frames: on fixtures of their own, and registered queries against DuckDB's answer."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from modelloom import registry
from modelloom.operators import attribution, duplicates, edits, graph, model_rules, quality
from modelloom.sources import parts

SF = "/root/testdata/sf0.001"
#: Those whose rounds are staged take long and have fixtures below; the rest are compared here.
STAGED = {"dependency_depth", "call_closure", "opt_dax_long_chain", "lineage_edges", "lineage_nodes", "lineage_of_a_page", "lineage_of_a_measure", "related_kpis", "replayed_changes", "replayed_expressions", "replayed_bindings", "replayed_relation_ends", "qa_findings", "primary_table", "closure_table_counts", "document_sections", "qa_finding_ids", "qa_scores", "dax_score", "qa_top_problems", "severity_histogram", "inbox_counts", "export_regressions"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_queries_agree_with_sql(spark):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    rounded = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    for name in registry.QUERIES:
        if name not in STAGED:
            got = registry.QUERIES[name](spark, SF)
            want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
            assert rounded(map(tuple, got.collect())) == rounded(want), name
    assert set(registry.ORACLE_SQL) == set(registry.QUERIES)


class Fixture(model_rules.Views):
    def __init__(self, frames):
        self.get = frames.__getitem__


def _measures(spark, rows):
    return spark.createDataFrame([(i, "Measures", n, e) for i, (n, e) in enumerate(rows)], "ord long, tbl string, name string, expression string")


def test_depths_of_chains_and_cycles(spark):
    calls = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("y", "d"), ("w", "x"), ("a", "c")]
    got = {r["name"]: r["depth"] for r in graph.depths(spark.createDataFrame(calls, "name string, ref string")).collect()}
    assert got == {"a": 5, "b": 4, "c": 3, "d": 2, "x": 4, "y": 3, "w": 5}
    reached = {(r["name"], r["reached"]) for r in graph.closure(spark.createDataFrame(calls, "name string, ref string")).collect()}
    assert ("w", "e") in reached and ("x", "x") in reached and ("e", "d") not in reached and len([1 for n, _ in reached if n == "a"]) == 4
    assert graph.depths(spark.createDataFrame([], "name string, ref string")).count() == 0


def test_closure_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds, staged = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: rounds.append(name) or staged(df, name))
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("n30", "n25")]
    got = [tuple(r) for r in graph.closure(spark.createDataFrame(chain, "name string, ref string")).select("name", "reached").collect()]
    want = {(f"n{i:02}", f"n{j:02}") for i in range(31) for j in range(min(i + 1, 25), 31)}
    assert set(got) == want and len(got) == len(want) and len(rounds) <= 7


def test_long_chains_take_as_many_rounds_as_asked_for(spark, monkeypatch):
    rounds, staged = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: rounds.append(name) or staged(df, name))
    # a long chain, cycles of two to five names, ways into and out of them, a name that calls itself
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(14)]
    loops = [(f"{k}_{i}", f"{k}_{(i + 1) % k}") for k in range(2, 6) for i in range(k)]
    calls = chain + loops + [("a", "2_0"), ("b", "a"), ("c", "3_0"), ("d", "4_0"), ("3_1", "x"), ("2_1", "n11"), ("s", "s"), ("s", "a"), ("y", "2_0"), ("2_0", "z")]
    frame = spark.createDataFrame(calls, "name string, ref string")
    got = {least: sorted(r["name"] for r in graph.deep(frame, least).collect()) for least in (3, 5)}
    assert len(rounds) <= 10
    depth = {r["name"]: r["depth"] for r in graph.depths(frame.where("name <> ref")).collect()}
    assert got == {least: sorted(n for n, d in depth.items() if d >= least) for least in (3, 5)}
    assert {"n10", "b", "d", "5_0"} <= set(got[5]) and not {"n11", "4_1", "c"} & set(got[5])


def test_long_views_are_not_broadcast(spark):
    views = model_rules.Views(spark, SF)
    plan = views.calls()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_edges_that_close_a_loop(spark):
    for edges in ([(0, "a", "b"), (1, "b", "c"), (2, "c", "a"), (3, "c", "c"), (4, "d", "e"), (5, "e", "d"), (6, "d", "a"), (7, "e", "b")], [(9 - i, f"n{i}", f"n{i + 1}") for i in range(9)], []):
        parent, want = {}, set()

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for o, a, b in sorted(edges):
            if find(a) == find(b):
                want.add(o)
            parent[find(a)] = find(b)
        assert {r["ord"] for r in graph.closing_edges(spark.createDataFrame(edges, "ord long, a string, b string")).collect()} == want


def test_orphans_and_auto_dates(spark):
    frames = {
        "dv_relations": spark.createDataFrame([("T1", "T2")], "a string, b string"),
        "dv_tables": spark.createDataFrame([(i, f"T{i}") for i in range(1, 5)] + [(9, "LocalDateTable_9"), (10, None)], "ord long, name string"),
        "dv_columns": spark.createDataFrame([("T1",), ("T3",), ("LocalDateTable_9",)], "tbl string"),
    }
    targets = lambda rule, f: sorted(r["target"] for r in model_rules.RULES[rule](Fixture(f)).collect())
    assert targets("qa_rel_orphan_table", frames) == ["T3"]
    alone = frames | {"dv_tables": frames["dv_tables"].where("name = 'T3'")}
    assert targets("qa_rel_orphan_table", alone) == []
    assert targets("opt_mod_auto_date", frames) == ["LocalDateTable_9"]
    assert targets("opt_mod_auto_date", alone) == []


def test_what_measures_and_visuals_name(spark):
    long = "SUM ( 'T 1'[A] )" + " + 1" * 100
    frames = {
        "dv_measures": _measures(spark, [("a", long), ("a", "FILTER ( T2, T2[B] > 0 )"), ("b", "filter ( 'T2', 1 ) + [gone]"), ("c", "FILTER ( None, T3[Key] ) + T3[Lost] // T4[D]"), ("y", "TOTALYTD ( 1 )")]),
        "dv_tables": spark.createDataFrame([("T2", None), ("T3", "Time"), ("T5", None), ("T8", None)], "name string, data_category string"),
        "dv_columns": spark.createDataFrame([(i, t, c, k) for i, (t, c, k) in enumerate([("T 1", "A", "x"), ("T2", "B", "x"), ("T2", "C", "x"), ("T3", "Key", "x"), ("T5", "Key", "int64"), ("T6", "Id", "string"), ("LocalDateTable_1", "E", "x"), ("T7", "F", "x")])], "ord long, tbl string, name string, data_type string"),
        "dv_relations": spark.createDataFrame([("T5", "Key", "T6", "Id"), ("T5", "Key", "T6", "None"), ("T5", "Key", "T5", "Key")], "a string, column_a string, b string, column_b string"),
        "dv_visuals": spark.createDataFrame([("p", "1", "card")], "page string, visual_id string, type string"),
        "dv_pages": spark.createDataFrame([("p", False), ("q", False), ("r", True)], "page string, is_hidden boolean"),
        "dv_refs": spark.createDataFrame([("p", v, "card", None, "a", "measure") for v in "123"] + [("q", "4", "card", "X", "a", "measure"), ("q", "5", "card", "T7", "F", "column"), ("q", "5", "card", "T7", "B", "column"), ("q", "6", "card", "T7", "gone", "column"), ("q", "6", "card", "T7", "gone", "hierarchy"), ("q", "7", "card", "T7", "C", "measure")] + [("q", "8", "matrix", "T7", f"F{i}", "hierarchy") for i in range(8)], "page string, visual_id string, type string, tbl string, field string, kind string"),
    }
    targets = lambda rule: sorted(r["target"] for r in model_rules.RULES[rule](Fixture(frames)).collect())
    assert targets("qa_dq_duplicate_measure_name") == ["a", "a"]
    assert targets("qa_dax_filter_whole_table") == ["a"]
    assert targets("qa_dq_measure_missing_dependency") == ["b", "c"]
    assert targets("qa_rep_broken_field") == ["q/6", "q/7"]
    assert targets("qa_dq_relationship_type_mismatch") == ["T5 -> T6"]
    assert targets("opt_mod_unused_column") == ["T2[C]"]
    assert targets("opt_mod_unused_table") == ["T8"]
    assert targets("opt_vis_repeated_measure") == ["p"]
    assert targets("opt_vis_large_grid") == ["q/8"]
    assert targets("qa_rep_empty_page") == ["q"]
    assert targets("qa_dq_no_date_table") == []
    frames["dv_tables"] = frames["dv_tables"].where("name <> 'T3'")
    assert targets("qa_dq_no_date_table") == ["y"]
    page = {r["page"]: r for r in model_rules.page_complexity(Fixture(frames)).collect()}
    assert (page["p"]["score"], page["p"]["band"]) == (2 + 1 + 3, "simple") and page["q"]["score"] == 6 + 13 and page["r"]["score"] == 0


def test_primary_tables_follow_calls(spark):
    frames = {
        "dv_measures": _measures(spark, [("m", "SUM ( Sales[x] ) + [n]"), ("n", "COUNTROWS ( Sales ) + 'Stock'[y] + [m]"), ("o", "[n]"), ("p", "1"), ("q", "Sales[a] + 'Stock'[b]")]),
        "dv_tables": spark.createDataFrame([("Sales",), ("Stock",)], "name string"),
    }
    got = {r["name"]: (r["primary_table"], r["confidence"], r["n"], r["second"]) for r in attribution.primary_tables(Fixture(frames)).collect()}
    assert got == {"m": ("Sales", "high", 2, 1), "n": ("Sales", "high", 2, 1), "o": ("Sales", "medium", 2, 1), "p": (None, "none", None, None), "q": (None, "low", 1, 1)}


def test_captions(spark):
    rows = [(0, "p", "t", "textbox", 0.0, 0.0, 100.0, 20.0, None, " Net  sales : "), (1, "p", "a", "card", 10.0, 30.0, 80.0, 40.0, None, None), (2, "p", "b", "card", 110.0, 0.0, 80.0, 30.0, "", None), (3, "p", "c", "card", 280.0, 200.0, 20.0, 20.0, None, None), (4, "p", "d", "card", 0.0, 900.0, 20.0, 20.0, None, None), (5, "p", "e", "card", 0.0, 22.0, 20.0, 20.0, "Own title", None), (6, "p", "f", "card", 0.0, 22.0, 20.0, 20.0, None, None)]
    frames = {
        "dv_visuals": spark.createDataFrame(rows, "ord long, page string, visual_id string, type string, x double, y double, width double, height double, title string, text string"),
        "dv_refs": spark.createDataFrame([(v, f"m_{v}", "T", "measure") for v in "abcde"] + [("f", "m_f", "T", "measure"), ("f", "m_g", "T", "measure"), ("e", "m_g", "T", "measure")], "visual_id string, field string, tbl string, kind string"),
    }
    got = {(r["visual_id"], r["field"]): (r["label"], r["source"], r["distance"]) for r in attribution.kpi_names(Fixture(frames)).collect()}
    want = {("c", "m_c"): ("Net sales", "caption-near", 312), ("a", "m_a"): ("Net sales", "caption-above", 10), ("b", "m_b"): ("Net sales", "caption-left", 10), ("e", "m_e"): ("Own title", "visual-title", None), ("e", "m_g"): ("Own title", "visual-title", None)}
    assert got == want


def test_duplicate_sources(spark):
    plain, sorts = "let s = Source in Table.TransformColumnTypes(s, x)", "let s = Source in Table.SelectRows(s, x)"
    rows = [
        ("A", "m", "SELECT x, y FROM dbo.Orders", plain), ("Orders", "m", "select Y,  o.X from dbo.orders", plain),
        ("B", "m", "SELECT x, coalesce(z, 0), [w] FROM dbo.Two WHERE  a = 1 ORDER BY x", plain), ("C", "m", "SELECT TOP 5 X FROM dbo.Two where a  = 1 -- WHERE", plain), ("D", "calculated", "SELECT x FROM dbo.Two", plain),
        ("E", "m", "SELECT * FROM Stars", plain), ("F", "m", "SELECT DISTINCT * FROM Stars", plain), ("G", "m", "SELECT * FROM stars", plain), ("H", "m", "SELECT * FROM Stars WHERE q = 1", sorts),
        ("I", "m", "SELECT a FROM Joined JOIN b ON 1=1", plain), ("J", "m", "SELECT a FROM Joined JOIN b ON 1=1", plain), ("K", "m", "SELECT a FROM Alone", plain), ("L", "m", "SELECT a FROM [br].x", plain), ("M", "m", "SELECT a FROM [br].x", plain),
    ]
    frames = {
        "dv_partitions": spark.createDataFrame([(i, t, k, "Sql.Database", "S", "D", None, q, m) for i, (t, k, q, m) in enumerate(rows)], "ord long, tbl string, source_type string, connector string, server string, db string, object string, statement string, script string"),
        "dv_columns": spark.createDataFrame([(1, "A", "x")], "ord long, tbl string, name string"), "dv_relations": spark.createDataFrame([(1, "A", "B"), (2, "C", "C"), (3, "H", "A")], "ord long, a string, b string"),
        "dv_refs": spark.createDataFrame([("p1", "A"), ("p2", "Orders"), ("p2", "A"), ("p3", "K")], "page string, tbl string"),
        "dv_measures": _measures(spark, [("m1", "SUM ( A[x] ) + A[y]"), ("m2", "COUNTROWS ( A )"), ("m3", "SUM ( Orders[x] ) -- A[x]")]),
    }
    got = {(r["verdict"], r["members"]): r for r in duplicates.duplicate_groups(Fixture(frames)).collect()}
    assert set(got) == {("exact", "A,Orders"), ("compatible", "B,C"), ("exact", "E,G"), ("unsafe", "E,F,G,H")}
    told = lambda key, *names: tuple(got[key][n] for n in names)
    counts = ("measures", "pages", "relations", "removable")
    assert told(("exact", "A,Orders"), "canonical", "statement", *counts) == ("Orders", "SELECT x, y FROM dbo.Orders", 1, 2, 2, 1)
    assert told(("compatible", "B,C"), "canonical", "statement", *counts) == ("B", "SELECT x, coalesce(z, 0), w FROM dbo.Two", 0, 0, 1, 1)
    assert told(("exact", "E,G"), "canonical", "statement", "removable") == ("E", None, 1)
    assert told(("unsafe", "E,F,G,H"), "canonical", "blockers", "statement", *counts) == ("E", "filter,grain,steps", None, 0, 0, 0, 0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_inbox_runs_the_rules_once(spark):
    plan = registry.QUERIES["inbox_counts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Union" not in plan and plan.count("parquet") == 2


def test_rules_skipped_and_inbox(spark):
    found = spark.createDataFrame([(1, None, None), (2, "m", None), (3, None, "l"), (4, "m", "l")], "file long, model_part string, layout_part string")
    got = {(r["file"], r["category"]): (r["rules_run"], r["rules_skipped"], r["reason"]) for r in quality.rules_run(quality.capabilities(found)).collect()}
    assert [got[i, "DAX"] for i in (1, 2, 3, 4)] == [(0, 7, "No model part."), (7, 0, None), (0, 7, "No model part."), (7, 0, None)]
    assert [got[i, "Report"] for i in (1, 2, 3, 4)] == [(0, 4, "No model part."), (0, 4, "No report part."), (3, 1, "No model part."), (4, 0, None)]
    hits = spark.createDataFrame([("R", "C", "high", "x"), ("R", "C", "high", "x"), ("R", "C", "low", "y")], "rule_id string, category string, severity string, target string")
    told = quality.identified(hits)
    assert sorted(r["finding_id"] for r in told.collect()) == ["R#x#0", "R#x#1", "R#y#0"]
    triage = spark.createDataFrame([("R#x#1", "resolved"), ("R#y#0", "flagged")], "finding_id string, state string")
    assert {r["severity"]: tuple(r)[1:] for r in quality.inbox(told, triage).collect()} == {"critical": (0, 0, 0, 0), "high": (1, 0, 1, 0), "medium": (0, 0, 0, 0), "low": (1, 1, 0, 0)}


def test_audit_of_whole_models(spark):
    """Each check tells what is missing, extra and different; nulls are values, layout isn't, twins are compared as a set."""
    shapes = {
        "tables": ("ord long, name string, description string, is_hidden boolean", [(1, "A", None, False), (2, "B", "x", True)], [(1, "A", "", False), (2, "B", "x", True)]),
        "columns": ("ord long, tbl string, name string, data_type string, kind string", [(1, "A", "k", "int", "data"), (2, "A", "l", "int", "data")], [(2, "A", "l", "int", "data"), (3, "B", "k", "int", "data")]),
        "measures": ("ord long, tbl string, name string, expression string, format_string string", [(1, "A", "m", "a +  b", None), (2, "A", "m", "c", "0"), (3, "A", "n", "d", None)], [(2, "A", "m", " c ", "0"), (1, "A", "m", "a + b", None), (3, "A", "n", "D", None)]),
        "relations": ("ord long, a string, column_a string, b string, column_b string, from_many boolean, to_many boolean, both_directions boolean, active boolean", [(1, "A", "k", "B", "k", True, False, False, True)], [(1, "A", "k", "B", "k", True, False, False, False)]),
        "partitions": ("ord long, tbl string, name string, source_type string, statement string", [(1, "A", "p", "m", "SELECT  1")], [(1, "A", "p", "m", "SELECT 1")]),
        "pages": ("ord long, page string, display_name string, is_hidden boolean", [(1, "p", "P", False)], []),
        "visuals": ("ord long, page string, visual_id string, type string, title string", [(1, "p", "v", "card", "T")], [(1, "p", "v", "card", None)]),
        "refs": ("ord long, page string, visual_id string, ref_ord int, tbl string, field string, kind string", [], [(1, "p", "v", 0, None, "f", "measure")]),
    }
    views = Fixture({f"{p}_{name}": spark.createDataFrame(rows, schema) for name, (schema, *both) in shapes.items() for p, rows in zip(("dv", "dx"), both, strict=True)})
    got = {r["check"]: tuple(r)[1:] for r in edits.model_audit(edits.objects(views, "dv"), edits.objects(views, "dx")).collect()}
    assert got == {
        "tables": (2, 0, 0, 1, "A", False), "columns": (2, 1, 1, 0, "A/k", False), "measures": (2, 0, 0, 1, "A/n", False), "formats": (2, 0, 0, 0, None, True), "relations": (1, 0, 0, 1, "A/k/B/k", False),
        "partitions": (1, 0, 0, 0, None, True), "statements": (1, 0, 0, 0, None, True), "pages": (1, 1, 0, 0, "p", False), "visuals": (1, 0, 0, 0, None, True), "titles": (1, 0, 0, 1, "p/v", False), "bindings": (0, 0, 1, 0, "p/v/0", False),
    }


def test_audit_and_versions(spark):
    a = spark.createDataFrame([("T", "x", "SUM ( 1 )"), ("T", "y", "2"), ("T", "z", None)], "tbl string, name string, expression string")
    b = spark.createDataFrame([("T", "x", "SUM  (\n1 )"), ("T", "z", "3"), ("T", "w", "4")], "tbl string, name string, expression string")
    assert {(r["name"], r["problem"]) for r in edits.measure_audit(a, b).collect()} == {("y", "missing"), ("z", "differs"), ("w", "extra")}
    records = spark.createDataFrame([(f"s{i % 30}", i) for i in range(60)], "sha256 string, created long")
    assert [r["created"] for r in edits.versions(records).collect()] == list(range(59, 34, -1))


def test_parts(spark):
    model = '{"model":{"tables":[{"name":"T","measures":[{"name":"M","expression":["SUM (","x )"]},{"name":"N","expression":"[M]"}],"columns":[{"name":"C"}]}]}}'
    rows = [("f", 0, "Report/layout", "[1]", False, False), ("f", 1, "/DataModelSchema", model, True, True), ("g", 0, "x.SemanticModel/model.bim", model, False, True), ("h", 0, "DataModel", "{", False, False), ("i", 0, "none", "é", True, False)]
    frame = spark.createDataFrame(rows, "file string, place int, part string, doc string, wide boolean, mark boolean")
    frame = frame.withColumn("bytes", parts.encoded(F.col("doc"), F.col("wide"), F.col("mark"))).drop("doc", "wide", "mark")
    assert {r["file"]: (r["format"], r["model_part"]) for r in parts.detected(frame).collect()} == {"f": ("pbit", "/DataModelSchema"), "g": ("pbip", "x.SemanticModel/model.bim"), "h": ("pbix", None)}
    got = {(r["file"], r["place"]): (r["text"], r["encoding"], r["bom"]) for r in parts.decoded(frame).collect()}
    assert got[("f", 1)] == (model, "utf-16le", True) and got[("g", 0)] == (model, "utf-8", True) and got[("h", 0)] == (None, None, None) and got[("f", 0)] == ("[1]", "utf-8", False)
    found = parts.models(parts.decoded(frame))
    assert {(r["file"], r["name"], r["expression"]) for r in parts.measures(found).collect()} == {(f, n, e) for f in "fg" for n, e in (("M", "SUM (\nx )"), ("N", "[M]"))}
    assert {r["data_type"] for r in parts.columns(found).collect()} == {"unknown"}
    odd = spark.createDataFrame([('a "b" #\n\t#(lf)',)], "e string")
    assert odd.select(parts.decode_m(parts.encode_m(F.col("e")))).first()[0] == 'a "b" #\n\t#(lf)'


def test_version_store(spark):
    from modelloom.sources.versions import VersionStore, content_hashes

    parts = [("f", "b", b"1"), ("f", "a", b"2"), ("g", "a", b"2"), ("g", "b", b"1"), ("h", "a", b"1"), ("h", "b", b"2"), ("i", "a", None)]
    got = {r["file"]: r["sha256"] for r in content_hashes(spark.createDataFrame(parts, "file string, part string, bytes binary")).collect()}
    assert got["f"] == got["g"] and len(set(got.values())) == 3
    shape = "sha256 string, created long, name string"
    store = VersionStore(spark, "versions_of_a_test", 2)
    store.save(spark.createDataFrame([("a", 1, "x"), ("a", 5, "newer"), ("b", 9, "y"), ("c", 2, "z")], shape), 0)
    store.save(spark.createDataFrame([("b", 3, "again"), ("c", 2, "z"), ("d", 4, "w")], shape), 1)
    assert {tuple(r) for r in store.current().collect()} == {("a", 5, "newer"), ("b", 3, "again"), ("c", 2, "z"), ("d", 4, "w")}
    assert spark.table("versions_of_a_test").count() == 5 and [r["sha256"] for r in store.kept(2).collect()] == ["a", "d"]
    plan = store.current()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE versions_of_a_test")


def test_coverage_counts_bare_models_too(spark):
    docs = ['{"model":{"tables":[{"name":"A","columns":[{"name":"c"}]}]}}', '{"tables":[{"name":"B","isHidden":true,"measures":[{"name":"m"}]}]}']
    got = {(r["kind"], r["property"]): r["n"] for r in parts.coverage(spark.createDataFrame([(d,) for d in docs], "text string")).collect()}
    assert got[("table", "name")] == 2 and got[("table", "isHidden")] == 1 and got[("measure", "name")] == 1 and got[("column", "name")] == 1
