"""Trigram queries and the secret scan against plain regular expressions; nulls, long and odd texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modelloom.llm.secret_scan import BASE, RULES, Rule, scan, secret_spans
from modelloom.llm.trigrams import ANY, candidates, placed, postings, trigram_query

DOCS = "doc_id long, text string, file string, row int, kinds string, spans int"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
PATTERNS = ["abc|de", "(abc)+x?def", "a.*bcd", "[Tt]oken[=:]x", "x{3,5}y", "(foo|bar)[0-9]baz", "pre(fix|face)s?", "q(w|e)?rty", r"^abc\b", "a[^b]cde", "(?:ab){2}c", "no{0,2}ne"]


def _found(text):
    """(start, place in the list of rules, end) by re alone."""
    out = []
    for place, rule in enumerate(RULES):
        if rule.kind == "assign":
            spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        elif rule.kind == "access":
            spans = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        elif rule.kind == "hex":
            spans = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        else:
            spans = [m.span() for m in re.finditer(rule.pattern, text)]
        out += [(a, place, b) for a, b in spans]
    return sorted(out)


def _row(doc_id, text):
    spans = _found(text or "")
    told = lambda xs: ",".join(f"{RULES[p].kind}:{a}:{b}" for a, p, b in xs)
    base = [x for x in spans if x[1] < len(BASE)]
    counts = [sum(x[1] == i for x in base) for i in range(len(BASE))]
    return (doc_id, *counts, hashlib.sha256(told(base).encode()).hexdigest(), told(spans))


def _texts():
    r = random.Random(3)
    key = "0123456789abcdef" * 2
    jwt = ".".join(["eyJhbGciOiJI", "eyJzdWIiOiIx", "c2lnbmF0dXJl"])
    texts = [None, "", "password: hunter22", "Password = 'abcdef'", "TOKEN=abc", "token:token:abcdefg", "secret==abcdef", "api_key\"  :  \"k-9/+=.x", "apikey=1234567", "passwd:12345 passwd:123456", "tok en=abcdef", f"x{key}y{key[:23]} {key[:24]}", "AKIA" + "A1" * 8, "AKIA" + "A" * 15, "XAKIAAKIA" + "B" * 14, "🙂é password=🙂 secret=naïve token=abcdefé", f"🙂 sha {key}", "-----BEGIN RSA PRIVATE KEY-----\nMII", "-----BEGIN PRIVATE KEY-----", "ghp_" + "a1" * 18, "ghx_" + "a" * 40, "xoxb-1234567890-abc", jwt, f"token={jwt}", "ToKeN:" + key, "ſecret=abcdef", "toKen=abcdef"]
    parts = ["password", "=", ":", " ", "'", "secret", "token=", "abcdef12", key, "AKIA", "ABCDEFGH12345678", "é", "\n", "api_key", "apikey:"]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(150)]
    return [*texts, "word " * 70_000 + "secret=" + "z" * 100_000 + " " + "token:abcdef " * 3000]


@pytest.fixture(scope="module")
def rows():
    rows = [(i, t, "f", 1, "k", 2) for i, t in enumerate(_texts())]
    return [*rows, *rows[:7], (None, "token=abcdef", "f", 1, "k", 2), (None, "token=abcdef", "f", 1, "k", 2)]


@pytest.mark.parametrize("from_files", [False, True])
def test_scan(spark, rows, tmp_path, from_files):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    if from_files:
        docs.write.parquet(f"file://{tmp_path}/docs")
        docs = spark.read.parquet(f"file://{tmp_path}/docs")
    got = sorted(map(tuple, scan(docs).collect()), key=repr)
    assert got == sorted((_row(d, t) for d, t, *_ in rows), key=repr)


def test_nothing_python_in_the_plan(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/docs")
    plan = scan(spark.read.parquet(f"file://{tmp_path}/docs"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_empty_table_and_spans(spark):
    assert scan(spark.createDataFrame([], DOCS)).collect() == []
    assert secret_spans(spark.createDataFrame([], DOCS)).collect() == []
    one = spark.createDataFrame([(4, "a secret=abcdef", "f", 1, "k", 2)], DOCS)
    assert [tuple(r) for r in secret_spans(one).collect()] == [(4, "assign", 2, 15)]
    assert [tuple(r) for r in secret_spans(one, [Rule("num", "[0-9]")]).collect()] == []


def _holds(query, text):
    return any(all(t in text.lower() for t in branch) for branch in query)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(PATTERNS + [r.pattern for r in RULES]), st.data())
def test_every_match_holds_the_query(pattern, data):
    text = data.draw(st.from_regex(pattern, alphabet=st.characters(codec="ascii")))
    assert _holds(trigram_query(pattern), text)


def test_queries():
    of = lambda *branches: frozenset(map(frozenset, branches))
    assert trigram_query("[0-9a-f]{24,}") == ANY and trigram_query("ab|abcd") == ANY
    assert trigram_query("AKIA[A-Z0-9]{16,}") == of(["aki", "kia"])
    assert trigram_query("(foo|bar)baz") == of(["foo", "oob", "oba", "baz"], ["bar", "arb", "rba", "baz"])
    assert trigram_query("abcx*def") == of(["abc", "def"])
    assert trigram_query("gh[op]_") == of(["gho", "ho_"], ["ghp", "hp_"])


def test_full_index_finds_candidates_for_later_rules(spark):
    r = random.Random(5)
    words = ["alpha", "Beta", "gam ma", "delta9", "été"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(4))) for _ in range(300)]
    places = placed(spark.createDataFrame([(i, t, "f", 1, "k", 2) for i, t in enumerate(texts)], DOCS)).persist()
    index = postings(places)
    queries = {p: trigram_query(p) for p in ("alpha|delta", "a[mM]a|beta", "9 été")}
    found = candidates(index, {"a": queries["alpha|delta"], "b": frozenset([frozenset(["bet", "eta"]), frozenset(["gam"])]), "c": queries["9 été"]})
    got = {x.doc_id: set(x.kinds) for x in places.join(found, ["file", "row"]).select("doc_id", "kinds").collect()}
    for i, t in enumerate(texts):
        t = t.lower()
        want = {k for k, yes in (("a", "alpha" in t or "delta" in t), ("b", "beta" in t or "gam" in t), ("c", all(x in t for x in ("9 é", " ét", "été")))) if yes}
        assert got.get(i, set()) == want
    # trigrams asked for one by one give the same postings
    few = postings(places, ["alp", "été", "9 é"])
    same = index.where(F.col("trigram").isin("alp", "été", "9 é"))
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, same.collect()), key=repr)
    places.unpersist()
