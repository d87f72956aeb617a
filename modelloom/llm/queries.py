"""The registered queries over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, prepare, table
from . import langid, toxicity
from .ann import nearest
from .arc_warc import convert, pages_to_arc, read_warc
from .divergence import divergence
from .exact_dedup import dedup
from .jaccard import jaccard_components
from .mixing import mix, quality
from .oracle import ORACLE_SQL as ORACLE_SQL
from .packing import pack
from .periodic import looped, periodic_runs
from .secret_scan import scan
from .span_dedup import remove_repeats
from .token_output import read_checked, write_tokens


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "before", 0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), quality()).select("doc_id", "size", "source_size", "target", "taken")


def op3_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"), 5)


def remainder(divisor: int) -> F.Column:
    """crc32 of doc_id as text, modulo `divisor`."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    return toxicity.score(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder(5) != 0))
    return langid.identify(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), k=2, least=20, alone=50)


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    convert(pages_to_arc(table(spark, sf_dir, "pages")), path)
    return read_warc(spark, path)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), "at", 2)
    return read_checked(spark, path)


def op11_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), looped)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_sum_of_squares_packing, op2_weighted_mixing, op3_one_bit_neighbours, op4_toxic_segments, op5_ngram_jaccard_join, op6_language_centroids, op7_exact_dedup, op8_sentence_spans, op9_arc_to_warc, op10_token_output, op11_secret_index, op12_source_divergence, op13_periodic_runs)}
