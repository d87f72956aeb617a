"""run() against a brute-force version of its stages on a small table."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

WORD = r"[^\x20\x09-\x0D]+"
EN = "the cat dog house with this went there and of for that have they river stone light morning".split()
DE = "der die das hund katze haus nicht und mit auf wurde sein haben sie fluss stein licht morgen".split()


def _table():
    r = random.Random(8)
    rows = []
    for i in range(60):
        words = [r.choice(EN if i % 2 else DE) for _ in range(r.randrange(40, 90))]
        rows.append((i, " ".join(words), "en" if i % 2 else "de", None if i % 10 == 0 else "hot" if i % 3 else f"s{i % 4}"))
    rows += [(60 + i, rows[i][1].replace(" ", "  ", 2), rows[i][2], rows[i][3]) for i in range(8)]
    rows += [(70 + i, f"{rows[20 + i][1]} end{i}", rows[20 + i][2], "s9") for i in range(8)]
    rows += [(80, None, None, None), (81, "", "en", "hot"), (82, "123 !! 45", "de", "s9"), (83, rows[1][1], None, "s0")]
    return rows


def _near(rows):
    sets = []
    for _, t, _, _ in rows:
        w = re.findall(WORD, t.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in itertools.combinations(range(len(rows)), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                root[a] = root[b] = min(root[a], root[b])
    return [row for i, row in enumerate(rows) if root[i] == i]


def _mixed(rows):
    """(doc_id, text) as often as the mix takes it, by sorting every source whole."""
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(re.findall(WORD, t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(size.values()), {}, set(names)
    while True:
        left, among = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * left >= 3 * size[s] * among]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            free.discard(s)
    target |= {s: weight[s] * left / among for s in free}

    def key(row):
        share = len(re.findall(r"[^\w\s]|[\d_]", row[1])) / max(1, len(row[1]))
        u = int(hashlib.md5(f"0:{row[0]}".encode()).hexdigest()[:13], 16)
        return -math.log((u + 0.5) / (1 << 52)) / max(0.05, 1 - 4 * share), row[0]

    out = []
    for s in names:
        epochs = int(target[s] // size[s])
        budget = round(target[s] - epochs * size[s])
        for d, t, _, _ in sorted((r for r in rows if r[3] == s), key=key):
            words = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)
            out += [(d, t)] * epochs
            part = min(len(words), budget)
            budget -= part
            if part:
                out.append((d, t if part == len(words) else "".join(words[:part])))
    return out


def test_run_is_the_brute_force_version(spark, tmp_path):
    rows = _table()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    first = {}
    for r in kept:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    want = _mixed(_near(list(first.values())))
    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = defaultdict(Counter)
    for d, t in want:
        ids[d].update([*code.encode(t, add_special_tokens=False).ids, 0])
    got, fills = defaultdict(Counter), defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p["doc_id"]].update(np.frombuffer(p["ids"], "<u4").tolist())
        fills[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == ids
    for pieces in fills.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end == 1024 or end & (end - 1) == 0


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_rows_without_or_with_repeated_ids(spark, tmp_path):
    r = random.Random(9)
    text = lambda: " ".join(r.choice(EN) for _ in range(r.randrange(40, 90)))
    rows = [(i, text(), "en", f"s{i % 2}") for i in range(12)]
    lone = [(None, text(), "en", f"s{i % 2}") for i in range(12)]
    rows += lone + [(None, lone[0][1], "en", "s0"), (None, f"{lone[1][1]} end", "en", "s1"), (None, f"{rows[2][1]} end", "en", "s0"), rows[3], rows[3], (5, text(), "en", "s1")]
    docs = spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact_dedup(spark, docs, "")
    want = list({x[1]: x for x in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))}.values())
    assert Counter((x["doc_id"], x["text"]) for x in exact.collect()) == Counter((x[0], x[1]) for x in want)
    exact.write.parquet(f"{tmp_path}/exact")
    near = corpus_pipeline.ngram_jaccard(spark, spark.read.parquet(f"{tmp_path}/exact"), "").collect()
    left = Counter((x["doc_id"], x["source"]) for x in near)
    assert left == Counter((x[0], x[3]) for x in _near(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))))
    spark.createDataFrame(near, docs.schema).repartition(3).write.parquet(f"{tmp_path}/near")
    mixed = corpus_pipeline.source_mixing(spark, spark.read.parquet(f"{tmp_path}/near"), "").collect()
    named = lambda d, t: (d, t) if d is not None else (f"text:{t}", t)
    brute = _mixed([(*named(x["doc_id"], x["text"]), None, x["source"]) for x in near])
    assert Counter(x["text"] for x in mixed) == Counter(t for _, t in brute)
    assert {(x["doc_id"], x["source"]) for x in mixed} <= set(left) and all(x["n_chars"] == len(x["text"]) for x in mixed)
