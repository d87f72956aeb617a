"""Small fixtures against brute force; nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import gzip
import hashlib
import itertools
import pathlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from modelloom.llm import ann, arc_warc, langid, tokens, toxicity
from modelloom.llm.ann import nearest
from modelloom.llm.components import components
from modelloom.llm.exact_dedup import DigestIndex, dedup
from modelloom.llm.jaccard import jaccard_components, jaccard_join
from modelloom.llm.mixing import mix, mixed_documents
from modelloom.llm.packing import Packer, pack
from modelloom.llm.span_dedup import deduplicated, remove_repeats
from modelloom.llm.token_output import read_checked, read_metadata, write_tokens
from modelloom.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n long, component string"


def _docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", ["en"] * len(texts))[i], more.get("source", ["s"] * len(texts))[i], 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def _words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def _texts():
    base = _words(1, 120)
    out = [" ".join(base), " ".join(base).upper(), None, "", "one", "one", "two words", "x " * 5000]
    for i in range(12):
        w = list(base)
        for j in range(i % 4):
            w[(17 * i + 29 * j) % 120] = f"edit{i}_{j}"
        out.append(" ".join(w))
    return out + [" ".join(_words(s, 60)) for s in range(50, 60)]


def _groups(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, k, percent):
    texts = _texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(_docs(spark, texts), k, percent).collect()}
    assert got == _groups(texts, k, percent)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_has_every_link(spark, k, percent):
    """Pairs and members give all links of brute force, those inside a near-copy group too, and the same components."""
    texts = _texts()
    pairs, members = jaccard_join(_docs(spark, texts), k, percent)
    first = {r["doc_id"]: r["first_id"] for r in members.collect()}
    linked = {(r["a"], r["b"]) for r in pairs.collect()}
    got = {(x, y) for x, y in itertools.combinations(sorted(first), 2) if first[x] == first[y] or tuple(sorted((first[x], first[y]))) in linked}
    want = {(x, y) for x, y in itertools.combinations(range(len(texts)), 2) if len(set(_groups([texts[x], texts[y]], k, percent)[i][1] for i in (0, 1))) == 1}
    # more than a tree of links over the nodes: pairs beside the leaders' are there
    assert got == want and len(linked) >= len({x for p in linked for x in p}) and pairs.count() == len(linked)
    component = dict(components(pairs).collect())
    assert {d: component.get(f, f) for d, f in first.items()} == {d: c for d, (n, c) in _groups(texts, k, percent).items() if n}


def test_jaccard_groups_just_below_the_threshold(spark):
    """Two large groups of near copies whose centres miss the threshold by a little, texts between them, and one link across."""
    r = random.Random(11)
    edited = lambda words, n: [f"e{r.random()}" if i in places else w for places in [set(r.sample(range(len(words)), n))] for i, w in enumerate(words)]
    first = _words(90, 160, 9999)
    second = [f"other{i}" if i < 22 else w for i, w in enumerate(first)]
    texts = [" ".join(edited(of, n)) for of in (first, second) for n in [0] + [1] * 12 + [2] * 8 + [3] * 6 + [5] * 6]
    texts += [" ".join(f"other{i}" if i < n else w for i, w in enumerate(first)) for n in (4, 19)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_components(_docs(spark, texts), 5, 80).collect()}
    assert got == _groups(texts, 5, 80) and len({c for _, c in got.values()}) > 3


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 130), 100)}


def test_exact_dedup_and_second_batch(spark):
    texts = ["a  b", "a b", None, "", "c", "a\tb"]
    index = DigestIndex(spark, buckets=2)
    got = {r["doc_id"]: r for r in dedup(_docs(spark, texts), index).collect()}
    assert [got[i]["keep_id"] for i in range(6)] == [0, 0, 2, 2, 4, 0]
    assert got[0]["group_size"] == 3 and got[0]["text_sha256"] == hashlib.sha256(b"a b").hexdigest()
    again = spark.createDataFrame([(50, "c"), (51, "new"), (52, "new")], "doc_id long, text string")
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in dedup(again, index).collect()} == {50: (4, False), 51: (51, True), 52: (51, False)}
    assert index.rows().count() == 4 and DigestIndex(spark, index.path, buckets=9).buckets == 2


def test_mixing_targets_and_budgets(spark):
    texts = [" ".join(_words(i, 5 + i % 9)) for i in range(200)] + [None, ""]
    source = [None if i % 7 == 0 else f"s{i % 5}" for i in range(202)]
    docs = _docs(spark, texts, source=source)
    rows = mix(docs).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        s = source[r["doc_id"]]
        by.setdefault(s, [r["target"], 0, r["source_size"]])[1] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert abs(sum(t for t, _, _ in by.values()) - total) < 1e-6
    assert all(abs(t - k) <= 1 and t <= 3 * n for t, k, n in by.values())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix(docs).collect()), key=str)
    # equal ids with different texts: reruns agree, however the rows lie
    twice = _docs(spark, texts).withColumn("doc_id", F.lit(7).cast("long"))
    assert sorted(map(tuple, mix(twice.repartition(3)).collect()), key=str) == sorted(map(tuple, mix(twice.coalesce(1)).collect()), key=str)
    clash = docs.selectExpr("*", "1 AS size", "2 AS epochs", "3 AS part", "4 AS copy", "5 AS `row`", "6 AS row_of_docs", "'p' AS path_of_row", "8 AS cut", "9 AS key")
    rows = mixed_documents(clash)
    assert rows.columns == clash.columns and {tuple(x)[6:] for x in rows.collect()} == {(1, 2, 3, 4, 5, 6, "p", 8, 9)}
    out = mixed_documents(docs)
    assert out.columns == docs.columns and sum(len((r["text"] or "").split()) for r in out.collect()) == sum(k for _, k, _ in by.values())


def test_packer_takes_the_level_of_least_squares():
    """Against trying every level: the sum over levels of squared counts of partly filled windows, ties to the fullest."""
    r = random.Random(7)
    for size in (8, 33):
        packer = Packer(size)
        for i in range(400):
            a = r.randrange(1, size)
            counts = packer.counts[:size].copy()
            cost = {}
            for h in range(size - a + 1):
                if h == 0 or counts[h]:
                    after = counts.copy()
                    after[h] -= h > 0
                    if h + a < size:
                        after[h + a] += 1
                    cost[h] = int((after[1:] ** 2).sum())
            best = min(cost.values())
            assert packer.level(a) == max(h for h, c in cost.items() if c == best)
            list(packer.put(i, np.zeros(a, "<u4").tobytes()))


def test_packer_fills_every_window():
    r = random.Random(3)
    packer, sizes = Packer(64), [r.randrange(1, 200) for _ in range(500)]
    rows = []
    for i, n in enumerate(sizes):
        rows += packer.put(i, np.arange(n, dtype="<u4").tobytes())
    rows += packer.end()
    fills, of = {}, {}
    for doc, start, ids, total, sequence, offset in rows:
        assert offset == fills.get(sequence, 0) and total == sizes[doc]
        fills[sequence] = offset + len(ids) // 4
        of.setdefault(doc, []).append((start, ids))
    assert all(n == 64 or n & (n - 1) == 0 for n in fills.values())
    assert all(b"".join(x for _, x in sorted(of[i])) == np.arange(n, dtype="<u4").tobytes() for i, n in enumerate(sizes))


TEXTS = ["a  b", "a \n b", " a ", "don't stop's", "ΣΑΣ İ", "é é", "foo.\nBar, baz!?", "12 34a", "<|endoftext|> hi", "x\0 y", "", "\n\nq", "a   b \n\n  c", "we'LL go 'Tis 1½ x²", "a\x1cb c", "ſ'ſ a\u200bb"]
#: Ranges of signs: scripts, marks, digits of many kinds, punctuation, emoji, controls.
RANGES = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x590, 0x700), (0x900, 0xA00), (0xE00, 0xE80), (0x1E00, 0x2070), (0x2070, 0x2200), (0x2460, 0x2500), (0x3000, 0x3100), (0x4E00, 0x5000), (0xA720, 0xA800), (0xAC00, 0xAD00), (0x1D400, 0x1D500), (0x1F300, 0x1F700), (0, 0x30), (0x180B, 0x1810)]


def _random_texts(n):
    r = random.Random(12)
    out = []
    for _ in range(n):
        a, b = r.choice(RANGES), r.choice(RANGES)
        out.append("".join(r.choice([chr(r.randrange(*a)), chr(r.randrange(*b)), " ", r.choice(TEXTS)]) for _ in range(r.randrange(1, 60))))
    return out


@pytest.mark.parametrize(("file", "split"), [("byte_bpe_50k.json", "before"), ("word_bpe_49k.json", "at"), ("word_bpe_49k.json", "")])
def test_ids_are_the_library_s(file, split, monkeypatch):
    """Hard cases, random texts of each script, a text longer than a slice and than a part, and a memo that overflows."""
    monkeypatch.setattr(tokens, "MEMO", 500)
    whole = Tokenizer.from_file(public_tokenizers.path(file))
    whole.encode_special_tokens = True
    texts = [*TEXTS, *_random_texts(2000), None, " ".join(_words(3, 1 << 17, 5000)) + " ", "  ".join(_words(4, 20000)) + "\u0301 é", "x" * 30000]
    begin, ids = Encoder(public_tokenizers.path(file), split).encode(texts)
    for i, t in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_a_memo_of_its_own_size_makes_each_piece_once(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    coder, made = Encoder(public_tokenizers.path("word_bpe_49k.json"), "at", 1000), []
    coder.memo.make = lambda piece: made.append(piece) or coder._part(piece)
    names = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwx'[i // 100]}" for i in range(400)]
    for words in (names[:200], names[200:], names[:200]):
        coder.encode([" ".join(words)])
    assert len(made) == len(set(made)) == 400


def test_pack_and_token_files(spark, tmp_path):
    docs = _docs(spark, [*TEXTS, None, "long " * 3000]).repartition(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Encoder(path, "at")
    want = {r["doc_id"]: coder.encode([r["text"]])[1].tobytes() + (2).to_bytes(4, "little") for r in docs.collect()}
    pieces = pack(docs, path, "at", 2, 256).collect()
    for d, ids in want.items():
        assert b"".join(bytes(r["ids"]) for r in sorted((r for r in pieces if r["doc_id"] == d), key=lambda r: r["start"])) == ids
    for encoding in ("dictionary", "delta"):
        write_tokens(docs, f"{tmp_path}/{encoding}", path, "at", 2, encoding)
        start = 0
        for r in sorted(read_checked(spark, f"{tmp_path}/{encoding}").collect()):
            assert tuple(r)[1:] == (start, len(want[r["doc_id"]]) // 4, zlib.crc32(want[r["doc_id"]]))
            start += r["n_tokens"]


def test_token_files_can_be_read_in_parts(spark, tmp_path):
    """Encodings, row groups of the chosen size, page indexes of every column, and a read of metadata that leaves the ids out."""
    docs = _docs(spark, [" ".join(_words(i, 200, 9000)) for i in range(2400)])
    for encoding, name in (("dictionary", "DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = f"{tmp_path}/{encoding}"
        write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), "at", 2, encoding, row_group=64 << 10, page=4 << 10)
        groups = 0
        for file in sorted(pathlib.Path(path).glob("*.parquet")):
            meta = pq.ParquetFile(file).metadata
            groups += meta.num_row_groups
            for g in range(meta.num_row_groups):
                columns = [meta.row_group(g).column(c) for c in range(meta.num_columns)]
                ids = next(c for c in columns if c.path_in_schema.startswith("ids"))
                assert any(name in e for e in ids.encodings) and all(c.has_offset_index for c in columns)
                doc = next(c for c in columns if c.path_in_schema == "doc_id")
                assert doc.has_column_index and doc.statistics.min <= doc.statistics.max
        assert groups > len(list(pathlib.Path(path).glob("*.parquet")))
        plan = read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
        assert "n_tokens" in plan and "ids" not in plan.partition("ReadSchema: ")[2].partition(">")[0]
        assert read_metadata(spark, path).agg(F.sum("n_tokens"), F.max("start")).first()[0] > 2400 * 200
    assert read_checked(spark, path).where("doc_id = 7").count() == 1
    write_tokens(docs.where("false"), f"{tmp_path}/none", public_tokenizers.path("word_bpe_49k.json"), "at", 2)
    assert read_checked(spark, f"{tmp_path}/none").count() == 0


def test_every_language_is_learned(spark):
    """More languages than the sample has rows for: each gives its first row at least."""
    texts = [f"{chr(97 + i) * 5} {chr(97 + i) * 3}{chr(98 + i)} text{chr(97 + i)}" for i in range(12) for _ in range(3)]
    model = langid.fit(_docs(spark, texts, lang=[f"l{i // 3:02d}" for i in range(36)]), per_language=2, total=6)
    assert model.languages == [f"l{i:02d}" for i in range(12)]


def test_spans(spark):
    passage = "Here one two three four five. Then six seven eight nine ten eleven. At last twelve thirteen fourteen."
    texts = [f"First own words. {passage} Own end.", f"Other start here. {passage} Other end.", "Clean text. Nothing in it repeats. At all.", None, ""]
    got = {r["doc_id"]: r for r in remove_repeats(_docs(spark, texts), k=2, least=10).collect()}
    assert list(got) == [1] and got[1]["kept_text"] == "Other start here. Other end." and got[1]["first_doc_ids"] == [0]


def test_spans_of_rows_that_share_an_id(spark):
    passage = "Here one two three four five. Then six seven eight nine ten eleven. At last twelve thirteen fourteen."
    other = "Own first sentence here. Second unrelated one here. Third unrelated one here. Fourth unrelated one."
    rows = [(1, f"Start. {passage}", "x"), (2, f"Begin. {passage} End.", "y"), (2, other, "z"), (None, passage, "n"), (3, None, "e"), (4, "word " * 80_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = [(r["doc_id"], r["kept_text"]) for r in remove_repeats(docs, k=2, least=10).collect()]
    assert got == [(2, "Begin. End.")]
    want = sorted([(1, rows[0][1], "x"), (2, "Begin. End.", "y"), (2, other, "z"), *rows[3:]], key=str)
    assert sorted(map(tuple, deduplicated(docs, k=2, least=10).collect()), key=str) == want
    assert deduplicated(docs.where("false")).count() == 0


def test_spans_of_long_quoted_and_short_sentences(spark):
    """With the query's parameters: a repeated run of 50 words with ragged ends loses the spans that lie inside it."""
    w = lambda seed, n: " ".join(_words(seed, n, 9999))
    inside = [f"{w(1, 55)}.", f'{w(2, 12)}." {w(3, 13)}?\u201d', f"{w(4, 12)}\u3002 {w(5, 12)}\u0964", " ".join(f"{w(10 + i, 6)}." for i in range(9)), f"{w(6, 9)}.) {w(7, 9)}!\u00bb {w(8, 9)}."]
    texts, kept = [], []
    for i, passage in enumerate(inside):
        ragged = lambda j, x, i=i: f"{w(100 + 10 * i + j, 20)} {w(200 + i, 15)}. {x} {w(300 + i, 15)} {w(400 + 10 * i + j, 20)}."
        texts += [ragged(0, passage), ragged(1, passage)]
        kept.append(ragged(1, "@").replace("@ ", ""))
    got = {r["doc_id"]: r["kept_text"] for r in remove_repeats(_docs(spark, texts), k=2, least=20, alone=50).collect()}
    assert got == {2 * i + 1: t for i, t in enumerate(kept)}


def test_language_and_rejection(spark):
    en, de = "the cat and the dog went to the house with this", "der hund und die katze gehen nicht in das haus"
    texts = [f"{en} {i}" for i in range(30)] + [f"{de} {i}" for i in range(30)] + [None, "", "123 !!"]
    docs = _docs(spark, texts, lang=["en"] * 30 + ["de"] * 30 + [None] * 3)
    model = langid.fit(docs)
    got = [r for r in sorted(langid.identify(docs, model).collect())]
    assert [r["lang_pred"] for r in got] == ["en"] * 30 + ["de"] * 30 + ["und"] * 3 and got[-1]["score"] == 0.0
    assert langid.keep_identified(docs, model).count() == 60
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_texts_in_no_learned_language_go(spark):
    r = random.Random(4)
    en = "the and of to in that it is was for on are with as his they at be this from have or by one had not but what all were when your can said there use each which she how their will other about out many then them these some her would make like him into time has look two more write go see number no way could people my than first water been call who its now find long down day did get come made may part".split()
    de = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden".split()
    clean = [(lang, " ".join(r.choice(of) for _ in range(n))) for lang, of in (("en", en), ("de", de)) for n in [15, 40, 80, 150] * 30]
    docs = _docs(spark, [t for _, t in clean], lang=[x for x, _ in clean])
    held_out = [" ".join(r.choice(of) for _ in range(n)) for of in (en, de) for n in [30, 90] * 10]
    foreign = [
        "Il governo ha deciso di aumentare le tasse sulla benzina e i cittadini non sono contenti della scelta fatta dal ministro",
        "Hallitus on päättänyt nostaa polttoaineen veroa eivätkä kansalaiset ole tyytyväisiä ministerin tekemään valintaan",
        "Hükümet benzin vergisini artırmaya karar verdi ve vatandaşlar bakanın yaptığı seçimden memnun değil",
        "Rząd postanowił podnieść podatek na benzynę a obywatele nie są zadowoleni z wyboru dokonanego przez ministra",
        " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30)),
    ]
    model = langid.fit(docs)
    got = [x["rejected"] for x in sorted(langid.identify(_docs(spark, held_out + foreign), model).collect())]
    assert got == [False] * 40 + [True] * 5
    assert langid.keep_identified(_docs(spark, held_out + foreign), model).count() == 40
    one = langid.fit(docs.where("lang = 'en'"))
    assert langid.keep_identified(docs, one).groupBy("lang").count().collect() == [("en", 120)]
    assert langid.keep_identified(_docs(spark, ["a", "1 2", None]), None).count() == 1


def test_segments_are_those_of_brute_force():
    r = random.Random(5)
    for _ in range(200):
        s = [r.choice([-3, -2, -1, 1, 2]) for _ in range(r.randrange(1, 14))]

        def parts(a, b):
            spans = [(sum(s[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            best = max(spans, default=(0, 0, 0, 0))
            return parts(a, best[2]) + [(best[2], best[3], best[0])] + parts(best[3], b) if best[0] > 0 else []

        assert sum(x for _, _, x in toxicity.segments(s)) == pytest.approx(sum(x for _, _, x in parts(0, len(s))))
    for _ in range(200):  # without ties the segments themselves are those of the definition
        s = [r.uniform(-3, 2) for _ in range(r.randrange(1, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == [(a, b) for a, b, _ in parts(0, len(s))]
    long = [1.0, -2.0] * 100_000  # every sum is less than all before
    assert len(toxicity.segments(long)) == 100_000


def test_toxicity(spark):
    texts = [" ".join(_words(i, 80) + ["vile"] * (i % 3 == 0) + ["foul"] * (i % 3 == 0)) for i in range(300)] + [None, ""]
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in range(300)) and got[300]["predicted"] == got[301]["predicted"] == 0


def test_neighbours_over_several_centres(spark, monkeypatch):
    """Clustered and scattered vectors over a dozen centres: at least 0.9 of brute force's neighbours, scores as on the original vectors."""
    monkeypatch.setattr(ann, "ROWS_A_CENTRE", 256)
    r = np.random.Generator(np.random.PCG64(2))
    heart = r.standard_normal((20, 24))
    x = np.concatenate([heart[r.integers(0, 20, 2000)] + 0.4 * r.standard_normal((2000, 24)), r.standard_normal((1000, 24))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(table, table.where("vec_id % 50 = 0"), 5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        mine = {g["vec_id"]: g["score"] for g in got if g["query_id"] == q}
        assert all(abs(v - s[i]) < 1e-12 for i, v in mine.items()) and len(mine) == 5
        hits += len(set(mine) & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 300


def test_neighbours(spark):
    r = np.random.Generator(np.random.PCG64(1))
    x = r.standard_normal((400, 16)).astype(np.float32)
    x[7] = x[8] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(table, table.where("vec_id % 50 = 0 OR vec_id = 9"), 5).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in [*range(0, 400, 50), 9]:
        s = u @ u[q]
        s[q] = -9
        mine = [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == q]
        hits += len(set(mine) & set(np.lexsort((np.arange(400), -s))[:5].tolist()))
        assert len(mine) == 5
    assert hits >= 0.9 * 45 and [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == 9][:2] == [7, 8]
    assert nearest(table.where("false"), table).count() == 0


def test_arc_to_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/ b", "x"), (2, None, "x"), (3, "http://c/", None), (4, "u", ""), (5, "u", "é\r\n\r\n" * 50000), (None, "n", "z")], "page_id long, url string, html string")
    arc_warc.convert(arc_warc.pages_to_arc(pages, 2), f"{tmp_path}/w")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in arc_warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert got == {1: ("revisit", 2, 1), 2: ("response", None, 1), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 300000), None: ("response", None, 1)}


def test_broken_archives():
    good = arc_warc.arc_archive("a", 2, [(1, "http://x/a b", "hi")])
    assert [r["kind"] for r in arc_warc.arc_records(good)] == ["warcinfo", "response"]
    assert list(arc_warc.arc_records(good))[1]["uri"] == "http://x/a b"
    assert [r["error"] for r in arc_warc.arc_records(good[:-3])] == [None, "shorter than declared"]
    assert [r["kind"] for r in arc_warc.arc_records(b"rubbish\n")] == ["unreadable"]
    # a wrong length costs the records it runs into, not all behind it
    three = arc_warc.arc_archive("a", 1, [(i, f"http://x/{i}", f"page {i}\n") for i in range(4)])
    at = three.index(b"http://x/1 ")
    end = three.index(b"\n", at)
    wrong = three[:at] + three[at:end].rpartition(b" ")[0] + b" 7" + three[end:]
    got = list(arc_warc.arc_records(wrong))
    assert [r["kind"] for r in got] == ["warcinfo", "response", "response", "unreadable", "response", "response"] and [r["page_id"] for r in got[4:]] == [2, 3]
    assert len({r["record_id"] for r in got}) == 6 and got == list(arc_warc.arc_records(wrong))


def test_archives_from_files_and_revisit_headers(spark, tmp_path):
    """gzip ARC files read from a folder; a page given twice; what a revisit points at is a record that is there."""
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/x.arc.gz").write_bytes(gzip.compress(arc_warc.arc_archive("x", 1, [(1, "http://a/", "same"), (2, "http://b/", "same")])))
    (tmp_path / "arc/y.arc").write_bytes(arc_warc.arc_archive("y", 2, [(3, "http://c/", "own"), (3, "http://c/", "own"), (4, "http://d/", "long " * 100_000)]))
    arc_warc.convert(arc_warc.read_arc(spark, f"{tmp_path}/arc"), f"{tmp_path}/w")
    blobs = [r["content"] for r in spark.read.format("binaryFile").load(f"{tmp_path}/w").collect()]
    heads = [arc_warc.headers(m.partition(b"\r\n\r\n")[0]) for b in blobs for m in arc_warc.members(bytes(b))]
    ids = [h["warc-record-id"] for h in heads]
    assert len(ids) == len(set(ids)) == 7
    revisit = [h for h in heads if h["warc-type"] == "revisit"]
    assert [(h["x-page-id"], h["warc-refers-to-target-uri"]) for h in revisit] == [("1", "http://b/")] and revisit[0]["warc-refers-to"] in ids and revisit[0]["warc-refers-to-date"].endswith("Z")
    got = sorted(tuple(r) for r in arc_warc.read_warc(spark, f"{tmp_path}/w").select("page_id", "record_type", "payload_bytes").collect())
    assert got == [(1, "revisit", 4), (2, "response", 4), (3, "response", 3), (3, "response", 3), (4, "response", 500_000)]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    arc_warc.convert(arc_warc.pages_to_arc(none), f"{tmp_path}/none")
    assert arc_warc.read_warc(spark, f"{tmp_path}/none").count() == 0


def test_empty_tables(spark):
    none = _docs(spark, ["x"]).where("false")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert [f(none).count() for f in (jaccard_components, dedup, mix, remove_repeats, lambda d: pack(d, path, "at", 2), lambda d: langid.identify(d, langid.fit(d)))] == [0] * 6


def test_jaccard_rows_that_share_an_id(spark):
    base = _words(2, 60)
    near = lambda i: " ".join([*base[:i], f"odd{i}", *base[i + 1 :]])
    a, b = " ".join(base), " ".join(_words(3, 60))
    near_b = b + " tail"
    rows = [(1, a), (1, b), (2, near_b), (3, near(0)), (None, near(59)), (None, None), (None, "alone"), (4, "alone"), (4, "alone"), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, 5, 80).collect()), key=repr)
    want = [(1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 56, 1), (None, 56, 1), (None, 0, None), (None, 1, 4), (4, 1, 4), (4, 1, 4), (5, 0, 5)]
    assert got == sorted(want, key=repr)


def test_jaccard_common_shingles_are_counted_and_come_last(spark, monkeypatch):
    from modelloom.llm import jaccard

    passages = [_words(100 + i, 40, 9999) for i in range(3)]
    r = random.Random(9)
    texts = []
    for i in range(120):
        own = _words(1000 + i, 40, 100_000)
        texts.append(" ".join(passages[i % 3] + own))
    texts += [" ".join(t.split()[:-1] + ["end"]) for t in texts[:20]] + [" ".join(passages[0])] * 3 + [" ".join(r.choice(passages)[:20]) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _groups(texts, 5, 80)
    made = {}
    for common in (8, 10_000, 7):
        monkeypatch.setattr(jaccard, "COMMON", common)
        if common == 7:  # beyond the bound of a broadcast
            monkeypatch.setattr(jaccard, "is_small", lambda df: False)
        _, _, _, lists = jaccard._lists(rows, 5, 80)
        made[common] = lists.groupBy("token").count().selectExpr("sum(count * count) AS pairs").first().pairs
        if common == 7:
            assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(rows, 5, 80).collect()} == want
    # common shingles left at their place by hash make far longer lists
    assert made[8] * 5 < made[10_000]


def test_a_long_record_leaves_other_files_as_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arc_warc, "CLASS_BYTES", 10_000)
    monkeypatch.setattr(arc_warc, "FILE_BYTES", 400_000)
    pages = [(i, f"http://h/{i}", f"page {i}") for i in range(60)] + [(60, "http://h/60", "x" * 300_000)]
    archives = arc_warc.pages_to_arc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1))
    path = f"file://{tmp_path}/warc"
    arc_warc.convert(archives.coalesce(1), path)
    assert {r.page_id: r.payload_bytes for r in arc_warc.read_warc(spark, path).collect()} == {i: len(h) for i, _, h in pages}
    assert len([x for x in (tmp_path / "warc").iterdir() if x.name.startswith("part-")]) <= 4


def test_languages_of_rows_without_ids_and_with_one(spark):
    words = {"aa": ["alpha", "banana", "lamina"], "bb": ["xyz", "quz", "zyx"]}
    r = random.Random(4)
    texts = [(lang, " ".join(r.choice(w) for _ in range(12))) for lang, w in words.items() for _ in range(120)]
    for doc_id in (None, 7):
        labelled = spark.createDataFrame([(doc_id, t, lang, "s", 1, "x") for lang, t in texts], DOCS)
        model = langid.fit(labelled, per_language=30)
        got = langid.identify(labelled, model).select("lang_pred").collect()
        assert sum(g.lang_pred == lang for g, (lang, _) in zip(got, texts, strict=True)) > 220
