"""Periodic runs of words, by Main and Lorentz's divide and conquer on interned word ids.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least `least` words and three
periods. A text is halved again and again; at each middle, two Z-functions (of the reversed left half before the text
reversed, and of the right half before the text) say for every period how far it holds to either side. Intervals that
are no run of the whole text, as a word beyond them goes on with the period, are dropped: the middle that they cross has
them whole. Of periods with one interval the smallest stays.

A run of at least `least` words and three periods repeats `least - least // 3` words at a distance of its period, so all of its
words lie in windows of so many words that stand at two places. Only stretches that such windows cover are halved; equal
hashes of windows can only make more of them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, only, prepare

LEAST, PERIODS = 24, 3

SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def z_function(s: list[int]) -> list[int]:
    """For each place how many elements from there on are as those from the start; the first is the length."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = 0
        if i < hi:
            k = z[i - lo]
            if k < hi - i:
                z[i] = k
                continue
            k = hi - i
        j = i + k
        while j < n and s[j] == s[j - i]:
            j += 1
        z[i] = j - i
        if j > hi:
            lo, hi = i, j
    return z


def _crossing(left: list[int], right: list[int], least: int) -> set[tuple[int, int, int]]:
    """(words before the middle, words behind it, period) of the repetitions of three periods or more over the middle."""
    a, b = len(left), len(right)
    most = (a + b) // PERIODS
    mirrored = left[::-1]
    found = set()
    # a period that lies behind the middle: it goes on to the right of it, and to the left from its end
    q = np.arange(1, min(most, b) + 1)
    if len(q):
        tail = right[: len(q)][::-1]
        on = np.array(z_function(right), np.int64)
        on = np.append(on, 0)[q]
        back = np.array(z_function([*mirrored, -1, *tail, *mirrored])[a + 1 :], np.int64)
        back = np.minimum(back[len(q) - q], a)
        total = back + q + on
        for i in np.flatnonzero((total >= PERIODS * q) & (total >= least)).tolist():
            found.add((int(back[i]), int(q[i] + on[i]), i + 1))
    # and before it
    q = np.arange(1, min(most, a) + 1)
    if len(q):
        head = left[a - len(q) :]
        on = np.array(z_function(mirrored), np.int64)
        on = np.append(on, 0)[q]
        ahead = np.array(z_function([*right, -1, *head, *right])[b + 1 :], np.int64)
        ahead = np.minimum(ahead[len(q) - q], b)
        total = on + q + ahead
        for i in np.flatnonzero((total >= PERIODS * q) & (total >= least)).tolist():
            found.add((int(q[i] + on[i]), int(ahead[i]), i + 1))
    return found


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def repeated_stretches(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """The maximal stretches of words that lie in windows which stand at two places or more."""
    width = least - least // PERIODS
    m = len(ids) - width + 1
    if m < 2 or len(ids) < least:
        return []
    # the hash of a window is put together from those of windows of powers of two
    h = _mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    whole, done, size = None, 0, 1
    while True:
        if width & size:
            part = h[done : done + m]
            whole = part if whole is None else _mix(whole * np.uint64(0xD6E8FEB86659FD93) + part)
            done += size
        if done == width:
            break
        h = _mix(h[:-size] * np.uint64(0x9FB21C651E98DF25) + h[size:])
        size *= 2
    order = np.argsort(whole, kind="stable")
    same = whole[order[1:]] == whole[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.subtract.at(edge, at + width, 1)
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    starts, ends = np.flatnonzero(~covered[:-1] & covered[1:]), np.flatnonzero(covered[:-1] & ~covered[1:])
    return [(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s >= least]


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(ids)
    period: dict[tuple[int, int], int] = {}
    for s, e in repeated_stretches(ids, least):
        words = ids[s:e].tolist()
        todo = [(0, e - s)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < least:
                continue
            mid = (lo + hi) // 2
            for back, on, q in _crossing(words[lo:mid], words[mid:hi], least):
                a, b = s + mid - back, s + mid + on
                if (a and ids[a - 1] == ids[a - 1 + q]) or (b < n and ids[b] == ids[b - q]):
                    continue
                period[a, b] = min(q, period.get((a, b), q))
            todo += [(lo, mid), (mid, hi)]
    return sorted((a, b - a, q) for (a, b), q in period.items())


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run keeps its first period only."""
    keep = np.ones(n, bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return keep


def _greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the most periods; of ties the first, then the one with the smaller period. Compared exactly."""
    best = found[0]
    for r in found[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten, by its id, with a part that goes on repeating from some word to the end: planted
    cases, the same at every run. Documents without an id stay as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def _rows(change: Callable[[int | None, list[bytes]], list[bytes]] | None, least: int, collapsed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            texts = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                if change:
                    words = change(doc_id, words)
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                found = runs(ids, least)
                kept = b" ".join(w for w, k in zip(words, kept_words(len(words), found).tolist(), strict=True) if k) if found else b" ".join(words)
                best = _greatest(found) if found else (None, None, None)
                told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                row = (doc_id, len(words), len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
                for column, x in zip(out, row, strict=True):
                    column.append(x)
                texts.append((found, kept))
            columns = [pa.array(x, pa.int64()) for x in out[:7]] + [pa.array(x, pa.string()) for x in out[7:]]
            columns.append(pa.array([[{"start": s, "length": n, "period": q} for s, n, q in found] for found, _ in texts], _RUNS))
            names = [x.strip().split(" ")[0] for x in SCHEMA.split(", runs ")[0].split(",")] + ["runs"]
            if collapsed:
                columns.append(pa.array([kept for _, kept in texts], pa.binary()).cast(pa.string()))
                names.append("collapsed")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST, collapsed: bool = False) -> DataFrame:
    """A row for each row of `docs` (doc_id, text, ...), in its order: n_words, all its runs, the one with the most periods (start,
    length, period, exponent_milli; nulls without runs), digests of the runs and of the text whose runs keep their first period
    only, and with `collapsed` that text.

    Words are `[^\\x20\\x09-\\x0D]+`, of whole texts of any length; a text takes memory in proportion to its own words. Null, empty
    and blank texts have no words and no runs. Null and repeated ids come back as they are; other columns are ignored. An empty
    table gives an empty result. `change` may give other words for a document before runs are looked for. Nothing is shuffled.
    """
    if least < PERIODS:
        raise ValueError(f"least must be {PERIODS} or more")
    prepare(docs.sparkSession)
    shape = SCHEMA + (", collapsed string" if collapsed else "")
    return only(docs, doc_id="bigint", text="string").mapInArrow(lean(_rows(change, least, collapsed)), shape)
