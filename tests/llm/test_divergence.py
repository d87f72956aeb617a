"""Source divergence against brute force in Python's whole numbers; nulls, ties, repeated rows, an empty table, clashing columns, many tiles."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from modelloom.llm import divergence as d
from modelloom.llm.divergence import compared, divergence, rates

DOCS = "doc_id long, text string, lang string, source string, term string, part int, n string, block string"


def _fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _brute(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _fold(text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: {t: counts[lang, s][t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(c[t] for c in of.values()) for t in kept}
        rate = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        p, q = {s: rate(c) for s, c in of.items()}, rate(whole)
        for s in of:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in of if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(found)]
    return sorted(out)


def _rows(seed, n, sources=9):
    r = random.Random(seed)
    pools = {"en": [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)], "fr": ["été", "Où", "ÇA", "naïve", "日本", "É1x"], "": ["solo"]}
    rows = []
    for i in range(n):
        lang = r.choice([*pools, None])
        words = [r.choice(pools[lang or ""]) for _ in range(r.randrange(12))]
        rows.append((i if i % 5 else None, r.choice([" ".join(words), "-".join(words).upper(), "9".join(words)]), lang, r.choice([*(f"s{k}" for k in range(sources)), "é", None]), "t", 3, "n", "b"))
    return [*rows, (1, None, "en", "never", "t", 3, "n", "b"), (1, "", "xx", "a", "t", 3, "n", "b"), (1, "once", "xx", "b", "t", 3, "n", "b"), *rows[:20]]


def _same(spark, rows, **how):
    got = divergence(spark.createDataFrame(rows, DOCS).repartition(5), **how)
    assert got.dtypes[-2:] == [("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == _brute(rows, how.get("least_docs", 3), how.get("top", 200))


def test_whole_result(spark):
    _same(spark, _rows(1, 300))


def test_many_tiles_of_few_sources_and_terms(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 5)
    monkeypatch.setattr(d, "PART", 3)
    _same(spark, _rows(2, 300), top=4)


def test_tasks_that_give_counts_often(spark, monkeypatch):
    # the functions run in workers, so the bound is tried here
    import pyarrow as pa

    monkeypatch.setattr(d, "ENTRIES", 2)
    batches = [pa.RecordBatch.from_arrays([pa.array(["l", "l"]), pa.array(["s", "s"]), pa.array([t, "b a"])], ["lang", "source", "text"]) for t in ("a B c", "c c", "")]
    total = Counter()
    for x in d._counted(iter(batches)):
        for term, n, docs in zip(*(x.column(c).to_pylist() for c in ("term", "n", "docs")), strict=True):
            total[term] += n + 100 * docs
    assert total == {"a": 404, "b": 404, "c": 203}


def test_rates_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**12, 4 * 10**15, 123456789012345], np.int64)
    for total in (5 * 10**15, 4 * 10**15 + 1):
        assert rates(counts, np.int64(total)).tolist() == [1 + 10**9 * (c + 1) // total for c in counts.tolist()]


def test_comparisons_in_steps(monkeypatch):
    monkeypatch.setattr(d, "STEP", 8)
    r = np.random.default_rng(1)
    a, b = r.integers(1, 10**9, (3, 17)), r.integers(1, 10**9, (2, 17))
    x, y = compared(a, b)
    for i in range(3):
        for j in range(2):
            p, q = a[i].tolist(), b[j].tolist()
            assert x[i, j] == sum((s - t) ** 2 // t for s, t in zip(p, q)) and y[i, j] == sum((s - t) ** 2 // s for s, t in zip(p, q))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, "t", 1, "n", "b")]])
def test_tables_without_pairs_or_terms(spark, rows):
    assert divergence(spark.createDataFrame(rows, DOCS)).collect() == []


def test_very_long_text(spark):
    rows = [(i, "Long Tail " * 50_000 + f"x{'y' * i}", "en", f"s{i % 2}", "t", 1, "n", "b") for i in range(4)]
    _same(spark, rows)
