"""A training-corpus pipeline over the corpus operators: language, near copies, secrets, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import bpe, langid, mixing, ngram_join, secrets
from barsmith.llm.common import written
from barsmith.llm.substrings import file_chunk

#: SQL cannot express language identification; the stages are tested against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language is told with a calibrated probability of 0.5 or more."""
    return langid.keep_identified(docs, least=0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of word 5-grams at a Jaccard similarity of 0.8 connect, one stays: that with the smallest
    doc_id, of those the first by place; one without an id only if no row of the group has one. Documents
    without words stay; of these, repeated rows with an id come once."""
    row = F.xxhash64("_metadata.file_path", "_metadata.row_index")  # a stage's docs are a table of files
    keyed = docs.select("*", row.alias("__row"))
    placed = docs.select(row.alias("doc_id"), "text", file_chunk(ngram_join.CHUNK).alias("place"))
    found = ngram_join.linked(placed, percent=80, n=5, chunk=F.col("place")).withColumnRenamed("doc_id", "__row")
    ids = docs.select(row.alias("__row"), "doc_id", F.xxhash64("text").alias("content"))
    empty = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = [F.when(~empty, F.col("component_id")).alias("component"), F.when(empty, F.col("doc_id")).alias("id"), F.when(empty, F.col("content")).alias("content")]
    first = found.join(ids, "__row").groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))["__row"].alias("__row"))
    return keyed.join(first.select("__row"), "__row", "left_semi").drop("__row")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; keeps every document."""
    return secrets.redact(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in part, as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded text."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), bpe.vocabulary(), then=bpe.IDS_AND_DIGESTS)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_to_targets),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
