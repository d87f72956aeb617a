"""N-gram Jaccard join by adaptive multi-match prefixes, with star links first so that no large group is paired out.

1. Each document becomes the set of its k-word shingles. Equal sets form a class; one member stands for it.
2. One global order of shingles, rare ones first: by hash, but shingles that are common come last, by how common they are.
   Common are those that stand in the prefixes of over COMMON documents; documents that have one in their prefix take
   it anew, which may tell further common ones, for some rounds. Counts are exact, of shingles by key, whatever the input.
3. A set of n shingles has a base prefix of n - ceil(t n) + 1 of its first shingles. Two sets that reach the threshold
   share at least l shingles of the prefixes lengthened by l - 1. Each set picks its own l in 1..MAX_L: the one of least
   cost, sum(list lengths) for reading lists + VERIFY * sum(list lengths) / l for the pairs that can reach l matches.
   A pair needs the smaller l of the two.
4. Stars: in each list the set with the most left after the shingle leads; members are verified against leaders only,
   first against the one they meet most often, then against those still in other components. Components follow.
5. Rest: lists that hold two or more components are paired component by component first (by bounds on sizes and
   positions). Where a component has several members, the count of shingles that a document shares with all of them
   bounds what it shares with any; only documents that this leaves open are paired, member by member, for pairs in
   different components only. Those with enough shared prefix shingles pass a bitmap bound and are verified. What is left
   out cannot link or is linked already, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, is_small, lean, numbered, only, prepare, shingle_sets, staged, text_buffers, unused
from .components import components, groups

MAX_L = 4
#: Members of a component that may share a shingle for it to be tried first.
SHORT = 64
VERIFY = 8.0
#: A shingle is common if more documents than this have it in their prefix; in so many rounds further ones are looked for.
COMMON, ROUNDS = 64, 4


def _profile(k: int):
    """Per document its size, digests of its set and a parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, bits = [], [], [], []
            for s in shingle_sets(*text_buffers(batch.column(1)), k):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    hi.append(int((s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)))
                    lo.append(int(((s ^ (s >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64).view(np.int64)))
                wide = max(256, 1 << (len(s) - 1).bit_length() if len(s) else 0)
                bits.append(np.packbits((np.bincount((s & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1).astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, hi, lo)), pa.array(bits, pa.binary())], ["doc_id", "n", "hi", "lo", "bits"])

    return run


def _longest(n, percent: int):
    """Shingles in the longest prefix of a set of n."""
    return n - -(-percent * n // 100) + MAX_L


def _shingles(k: int, percent: int, ahead: int = 1, common=None):
    """(token, doc_id, n, place): the first shingles of each set, `ahead` times its longest prefix; all of it if ahead is 0. `common`, a
    broadcast of sorted shingles with their counts, come after all others and by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "doc_id", "n", "place"]
        known, counts = common.value if common else (None, None)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            out: list[list[np.ndarray]] = [[], [], [], []]
            held = 0
            for d, s in zip(ids, shingle_sets(*text_buffers(batch.column("text")), k), strict=True):
                n = len(s)
                m = min(n, ahead * _longest(n, percent)) if ahead else n
                if not m:
                    continue
                if known is not None:
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, counts[at], 0)
                    s = s[np.argsort(rank, kind="stable")]
                out[0].append(s[:m].view(np.int64))
                out[1].append(np.full(m, d, np.int64))
                out[2].append(np.full(m, n, np.int32))
                out[3].append(np.arange(m, dtype=np.int32))
                held += m
                if held > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)
                    out, held = [[], [], [], []], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)

    return run


_ENTRIES = "token long, doc_id long, n int, place int"


def _ordered(docs: DataFrame, common: DataFrame, k: int, percent: int, ahead: int) -> DataFrame:
    """_ENTRIES of `docs` with `common` (token, c) last: looked up in a broadcast array if they are few, else by a join of whole sets."""
    if is_small(common):
        rows = common.orderBy(F.col("token").bitwiseXOR(F.lit(-(1 << 63)))).toPandas()
        shared = docs.sparkSession.sparkContext.broadcast((rows["token"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)))
        return docs.mapInArrow(lean(_shingles(k, percent, ahead, shared)), _ENTRIES)
    ranked = docs.mapInArrow(lean(_shingles(k, percent, 0)), _ENTRIES).drop("place").join(common, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("c", F.col("token").bitwiseXOR(F.lit(-(1 << 63)))))
    return ranked.withColumn("place", place - 1).where(f"place < {ahead} * ({_LONGEST.format(percent=percent)})").select("token", "doc_id", "n", "place")


_LONGEST = f"n - ({{percent}}L * n + 99) DIV 100 + {MAX_L}"


def _prefixes(docs: DataFrame, single: DataFrame, k: int, percent: int) -> DataFrame:
    """_ENTRIES of the longest prefix of every document of `single`, in the one order that all share.

    Each round tells further common shingles and gives those that have one in their prefix a new one, with twice as many
    shingles looked at as the round before. The last round tells none; so whoever has a common one in its prefix has it in the
    place that all give it."""
    docs = docs.join(bounded(staged(single.select("doc_id"), "single")), "doc_id", "left_semi")
    fresh = staged(docs.mapInArrow(lean(_shingles(k, percent)), _ENTRIES), "entries")
    parts, common = [fresh], None
    for i in range(ROUNDS):
        found = fresh.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > COMMON)
        found = staged(found.join(bounded(common), "token", "left_anti") if common else found, "common")
        if found.isEmpty():
            break
        common = staged(common.union(found), "common") if common else found
        having = reduce(DataFrame.union, (p.where(f"place < {_LONGEST.format(percent=percent)}") for p in parts)).join(bounded(found), "token", "left_semi")
        touched = bounded(staged(having.select("doc_id").distinct(), "touched"))
        fresh = staged(_ordered(docs.join(touched, "doc_id", "left_semi"), common, k, percent, 2 ** (i + 1)), "entries")
        parts = [p.join(touched, "doc_id", "left_anti").select(*fresh.columns) for p in parts] + [fresh]
    return reduce(DataFrame.union, parts).where(f"place < {_LONGEST.format(percent=percent)}")


def _adapted(entries: DataFrame, percent: int) -> DataFrame:
    """(token, doc_id, n, rest, l): the lists of two documents or more, each document with its own length of prefix."""
    lengths = staged(entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "tokens")
    lists = staged(entries.join(lengths, "token").withColumn("base", F.expr(f"CAST(n - ({percent}L * n + 99) DIV 100 + 1 AS INT)")), "shared_entries")
    costs = [F.sum(F.when(F.col("place") < F.col("base") + i, F.col("c")).otherwise(0)) * (1.0 + VERIFY / (i + 1)) for i in range(MAX_L)]
    # a prefix can't be longer than its set
    chosen = lists.groupBy("doc_id", "n", "base").agg(*(c.alias(f"cost{i + 1}") for i, c in enumerate(costs)))
    best = F.array_min(F.array(*(F.when(F.col("base") + i <= F.col("n"), F.struct(F.col(f"cost{i + 1}").alias("cost"), F.lit(i + 1).alias("l"))) for i in range(MAX_L))))
    chosen = staged(chosen.select("doc_id", best["l"].alias("l")), "lengths")
    return lists.join(bounded(chosen), "doc_id").where("place < base + l - 1").select("token", "doc_id", "n", F.expr("n - place").alias("rest"), "l")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(*text_buffers(batch.column(1)), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return run


def _near(percent: int):
    """Keeps the pairs whose parity bitmaps, the wider folded onto the narrower, leave the threshold open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column("bitsa"), batch.column("bitsb"), (batch.column("na").to_numpy() + batch.column("nb").to_numpy()).tolist(), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                while len(p) > len(q):
                    p = p[: len(p) // 2] ^ p[len(p) // 2 :]
                while len(q) > len(p):
                    q = q[: len(q) // 2] ^ q[len(q) // 2 :]
                # |A xor B| = |A| + |B| - 2 |A and B| <= (|A| + |B|) (100 - t) / (100 + t)
                keep.append(int(np.bitwise_count(p ^ q).sum()) * (100 + percent) <= n * (100 - percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _check(percent: int):
    """Keeps the pairs whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate([p, q]))
                both = int((z[1:] == z[:-1]).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, docs: DataFrame, profile: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: first by bitmaps that bound the sets' difference from below, then by the sets."""
    bits = profile.select("doc_id", "n", "bits")
    for side in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{c}{side}") for c in bits.columns[1:])), side)
    near = pairs.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(lean(_near(percent)), "a long, b long")
    near = staged(near, "near")
    wanted = staged(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), "wanted")
    few = is_small(wanted)
    sets = docs.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lean(_sets(k)), "doc_id long, shingles binary")
    sets = staged(sets, "sets")
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    return staged(near.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(lean(_check(percent)), "a long, b long"), "links")


def _marked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of components, and whether both have one document each."""
    several = staged(labels.select("component").distinct(), "of_several")
    for x in "ab":
        pairs = pairs.join(bounded(several.select(F.col("component").alias(f"component{x}"), F.lit(True).alias(f"has{x}"))), f"component{x}", "left")
    return pairs.select("componenta", "componentb", F.expr("hasa IS NULL AND hasb IS NULL").alias("alone"))


def _tokens(k: int):
    """All shingles of each document: (token, component, doc_id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, ids = (batch.column(c).to_numpy() for c in ("component", "doc_id"))
            for d, c, s in zip(ids, of, shingle_sets(*text_buffers(batch.column("text")), k), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), c)), pa.array(np.full(len(s), d)), pa.array(np.full(len(s), len(s)))], ["token", "component", "doc_id", "n"])

    return run


def _members_apart(pairs: DataFrame, joined: DataFrame, links: DataFrame, docs: DataFrame, single: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links, and pairs (a, b) that may be further ones, of documents of different components, for pairs of components of which one has several members.

    Every shingle that two documents of different components share lies in two of the components here. A document's count
    of such shingles thus bounds what it shares with any of them, and its count of shingles that a component holds what it
    shares with any member: a document beside a large group that has too many shingles of its own to link with a member is
    told by these two counts and not once for each member.
    """
    sides = pairs.select(F.col("componenta").alias("component")).union(pairs.select("componentb")).distinct()
    members = staged(joined.join(bounded(staged(sides, "sides")), "component", "left_semi").select("doc_id", "component").distinct(), "members")
    tokens = staged(docs.join(bounded(members), "doc_id").select("doc_id", "component", "text").mapInArrow(lean(_tokens(k)), "token long, component long, doc_id long, n long"), "shingles")
    held = tokens.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    held = bounded(staged(held, "held"))
    common = staged(tokens.join(held, "token", "left_semi").groupBy("component", "doc_id", "n").agg(F.count(F.lit(1)).alias("common")), "common")
    most = common.groupBy("component").agg(F.max("common").alias("common"), F.min("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    for x in "ab":
        pairs = pairs.join(most.select(F.col("component").alias(f"component{x}"), *(F.col(c).alias(f"{c}{x}") for c in ("common", "n", "docs"))), f"component{x}")
    pairs = pairs.where(f"least(commona, commonb) * {100 + percent} >= (na + nb) * {percent}")
    # of each pair the component with fewer documents is told how many shingles each of them has in the other as a whole
    fewer = F.col("docsa") <= F.col("docsb")
    sides = pairs.select(F.when(fewer, F.col("componenta")).otherwise(F.col("componentb")).alias("component"), F.when(fewer, F.col("componentb")).otherwise(F.col("componenta")).alias("other"), F.when(fewer, F.col("nb")).otherwise(F.col("na")).alias("other_n"))
    sides = staged(sides, "pairs_near")
    own = staged(tokens.join(held, "token", "left_semi").join(bounded(staged(sides.select("component").distinct(), "fewer")), "component", "left_semi"), "own")
    whole = staged(tokens.join(held, "token", "left_semi").select("token", F.col("component").alias("other")).distinct(), "whole")
    cover = own.join(bounded(sides), "component").join(whole, ["token", "other"]).groupBy("doc_id", "n", "other", "other_n").agg(F.count(F.lit(1)).alias("both"))
    open_pairs = staged(cover.where(f"both * {100 + percent} >= (n + other_n) * {percent}").select("doc_id", "other"), "open")
    entries = staged(joined.join(bounded(members.select("doc_id")), "doc_id", "left_semi"), "entries_apart")
    b = entries.select("token", F.col("component").alias("other"), F.col("doc_id").alias("y"), *(F.col(c).alias(f"{c}b") for c in ("n", "rest", "l")))

    def met(pairs: DataFrame, b: DataFrame) -> DataFrame:
        a = entries.drop("component").join(bounded(pairs), "doc_id").select("token", "other", F.col("doc_id").alias("x"), *(F.col(c).alias(f"{c}a") for c in ("n", "rest", "l")))
        cross = a.join(b, ["token", "other"]).where(_fits(percent).format(x="least(resta, restb) + least(la, lb) - 1", y="least(na, nb)", m="na", n="nb"))
        return cross.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(F.least("la", "lb")).alias("l"))

    # what links is mostly found by shingles that few members have; the rest is paired in full only where this linked nothing
    short = staged(b.groupBy("token", "other").agg(F.count(F.lit(1)).alias("held")).where(f"held <= {SHORT}").drop("held"), "short")
    found = _links(met(open_pairs, b.join(short, ["token", "other"], "left_semi")).select("a", "b"), docs, single, k, percent)
    labels = bounded(components(links.union(found)))
    for c in ("doc_id", "other"):
        open_pairs = open_pairs.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")), c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
    apart = staged(open_pairs.where("doc_id_in <> other_in").select("doc_id", "other"), "still_open")
    return found, met(apart, b).where("c >= l").select("a", "b")


def _fits(percent: int) -> str:
    return f"least({{x}}, {{y}}) * {100 + percent} >= ({{m}} + {{n}}) * {percent}"


def _lists(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents, their profile with classes of equal sets, one document a class, and the shared tokens' lists."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = docs.sparkSession
    prepare(spark)
    docs = only(docs, doc_id="bigint", text="string")
    shape = "doc_id long, n long, hi long, lo long, bits binary, slice long, part long, counts binary"
    rows = staged(docs.mapInArrow(lean(_profile(k)), "doc_id long, n long, hi long, lo long, bits binary"), "profile")
    profile = staged(groups(rows, ["n", "hi", "lo"], "doc_id"), "classes")
    single = profile.where("n > 0 AND doc_id = first_id")
    lists = staged(_adapted(_prefixes(docs, single, k, percent), percent), "lists")
    return docs, profile, single, lists


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The whole join: all pairs (a, b), a < b, of different sets that reach the threshold, and members (doc_id, first_id, n_shingles).

    Documents of equal sets form a class, told by its smallest doc_id: `first_id`, which `a` and `b` name. Two documents link
    if their classes are one or a pair. Those with a null doc_id or without words are in neither table; a doc_id must not stand
    in two rows with different texts (number the rows first if it may). Pairs of a near-copy group grow with its square.
    """
    docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    docs, profile, single, lists = _lists(docs, k, percent)
    a, b = (lists.select("token", F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "rest", "l"))) for x in "ab")
    meet = a.join(b, "token").where("a < b").where(_fits(percent).format(x="least(resta, restb) + least(la, lb) - 1", y="least(na, nb)", m="na", n="nb"))
    meet = meet.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.least("la", "lb")).alias("l")).where("c >= l").select("a", "b")
    members = profile.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "first_id", F.col("n").alias("n_shingles"))
    return _links(meet, docs, single, k, percent), members


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of `docs` (doc_id, text, ...).

    Documents link when 100 |A and B| >= percent |A or B| for their sets of k-word shingles. Null or empty text and text
    without words: n_shingles 0, linked with nothing. Fewer than k words: the whole sequence is one shingle. Rows are told
    apart by their place: rows that share a doc_id or a text link by their own texts and come back as often as given; those
    with a null doc_id link too, and a component without any id is null. Other columns are ignored. An empty table gives
    an empty result.
    """
    row = unused("row_of_docs", docs.columns)
    rows = numbered(docs, row).select(F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = row_components(rows.select(F.col("row").alias("doc_id"), "text"), k, percent)
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("component"))
    labelled = staged(found.join(rows.select("row", "doc_id"), "row"), "labelled_rows")
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    named = labelled.join(bounded(staged(smallest.withColumn("several", F.lit(True)), "smallest")), "component", "left")
    return named.select("doc_id", "n_shingles", F.expr("CASE WHEN several THEN component_id ELSE doc_id END").alias("component_id"))


def row_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """As jaccard_components, for a `docs` whose doc_id is never null and never repeated."""
    docs, profile, single, lists = _lists(docs, k, percent)

    # stars: the leader of a list has the most left after the token
    leaders = staged(lists.groupBy("token").agg(F.max(F.struct("rest", F.expr("-doc_id").alias("d"), "n")).alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", F.expr("-top.d").alias("leader"), F.col("top.n").alias("leader_n")), "leaders")
    fits = _fits(percent)
    stars = lists.join(leaders, "token").where("doc_id <> leader").where(fits.format(x="n", y="leader_n", m="n", n="leader_n"))
    stars = staged(stars.groupBy("doc_id", "leader").agg(F.count(F.lit(1)).alias("c")), "stars")
    # first each member with the leader it meets most often, then with others that this has not put beside it
    pair = [F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")]
    first = stars.groupBy("doc_id").agg(F.max(F.struct("c", F.expr("-leader").alias("d"))).alias("top")).select("doc_id", F.expr("-top.d").alias("leader"))
    links = _links(first.select(*pair).distinct(), docs, single, k, percent)
    labels = components(links)
    small = bounded(labels)
    apart = stars.select("doc_id", "leader")
    for c in apart.columns:
        apart = apart.join(small.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")), c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
    links = links.union(_links(apart.where("doc_id_in <> leader_in").select(*pair).distinct(), docs, single, k, percent))
    labels = components(links)

    # what may still link different components
    joined = lists.join(bounded(labels.withColumnRenamed("node", "doc_id")), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    joined = staged(joined, "labelled")
    mixed = joined.groupBy("token", "component").agg(F.max(F.expr("rest + l - 1")).alias("rest"), F.min("n").alias("n"), F.min("l").alias("l"))
    mixed = staged(mixed, "mixed")
    several = mixed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    mixed = staged(mixed.join(several, "token", "left_semi"), "several")
    p, q = (mixed.select("token", *(F.col(c).alias(f"{c}{x}") for c in ("component", "rest", "n", "l"))) for x in "ab")
    meet = p.join(q, "token").where("componenta < componentb").where(fits.format(x="resta", y="restb", m="na", n="nb")).select("token", "componenta", "componentb", F.least("la", "lb").alias("l"))
    meet = staged(meet, "meet")
    enough = meet.groupBy("componenta", "componentb").agg(F.count(F.lit(1)).alias("c"), F.min("l").alias("least")).where("c >= least")
    pairs = staged(_marked(enough.select("componenta", "componentb"), labels), "pairs")
    lone = pairs.where("alone").select(F.col("componenta").alias("a"), F.col("componentb").alias("b"))
    found, cross = _members_apart(pairs.where("NOT alone").drop("alone"), joined, links, docs, single, k, percent)
    links, cross = links.union(found), lone.union(cross)
    more = _links(cross, docs, single, k, percent)
    labels = components(links.union(more))
    named = bounded(labels.select(F.col("node").alias("first_id"), "component"))
    return profile.where("n > 0").join(named, "first_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first_id").alias("component_id")).union(profile.where("n = 0").select("doc_id", "n", "doc_id"))
