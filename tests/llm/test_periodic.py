"""Periodic runs against brute force; nulls, empty and very long texts, ties, repeated rows, an empty table, clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modelloom.llm import periodic
from modelloom.llm.periodic import periodic_runs, runs, z_function

DOCS = "doc_id long, text string, start long, period string, runs int"


def _brute(words, least=24):
    """Every period, every stretch on which it holds; of one stretch the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in best.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.integers(1, 15), st.integers(0, 60), st.sampled_from([3, 5, 24]))
def test_runs_are_those_of_brute_force(words, p, n, least):
    words = words + (words[-p:] * 20)[:n] + words[: len(words) // 2]
    assert runs(np.array(words, np.int64), least) == _brute(words, least)


def test_z_function():
    r = random.Random(1)
    for _ in range(200):
        s = [r.randrange(2) for _ in range(r.randrange(30))]
        assert z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_rows_of_documents(spark):
    r = random.Random(7)
    loop = " ".join(["alpha", "beta", "gamma"] * 20)
    two = " ".join([*(f"u{i}" for i in range(9)), *["a", "b"] * 15, *(f"v{i}" for i in range(9)), *["c", "d"] * 15])
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(60_000)) + " " + "tick tock " * 20_000
    texts = [loop, None, "", " \t\n", "one", two, long, loop.replace(" ", " "), loop.replace(" ", "\v\f"), "x " * 24, "x " * 23]
    rows = [(i, t, 5, "p", 1) for i, t in enumerate(texts)] + [(None, loop, 5, "p", 1), (0, loop, 5, "p", 1)]
    got = periodic_runs(spark.createDataFrame(rows, DOCS).coalesce(1), collapsed=True).collect()
    assert [x.doc_id for x in got] == [r[0] for r in rows]
    for row, (_, text, *_) in zip(got, rows, strict=True):
        words = (text or "").encode().split()
        found = _brute(words) if len(words) < 1000 else [(60_000, 40_000, 2)]
        assert [(x.start, x.length, x.period) for x in row.runs] == found
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        assert row.collapsed == b" ".join(w for i, w in enumerate(words) if i not in drop).decode()
        assert row.collapsed_sha256 == hashlib.sha256(row.collapsed.encode()).hexdigest()
        assert (row.start is None) == (not found) and row.n_runs == len(found) and row.n_words == len(words)
    # of two runs with as many periods the first
    assert (got[5].start, got[5].length, got[5].period, got[5].exponent_milli) == (9, 30, 2, 15000)
    empty = periodic_runs(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and "collapsed" not in empty.columns


def test_planted_loops():
    words = [str(i).encode() for i in range(100)]
    changed = [i for i in range(400) if periodic.looped(i, words) != words]
    assert 20 < len(changed) < 60 and periodic.looped(None, words) == words and periodic.looped(3, []) == []
    for i in changed:
        import zlib

        h = zlib.crc32(str(i).encode())
        a = h // 10 % 100
        p = 1 + (100 - a) // (3 + h // 10 % 8)
        assert periodic.looped(i, words) == [words[j] if j < a else words[a + (j - a) % p] for j in range(100)]


def test_least_is_checked(spark):
    with pytest.raises(ValueError):
        periodic_runs(spark.createDataFrame([], DOCS), least=2)
