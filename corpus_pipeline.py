"""The corpus pipeline: documents to tokens in five stages, each over all that the one before it kept.

Toxic documents go; of near copies one stays; repeated substrings are cut from the texts; sources are mixed to their target shares;
and what is left is encoded. Each stage is written as Parquet to the shared folder and read again, so a lost executor costs at most
the stage under way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, simhash, suffixes, toxicity
from quarry.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on the labelled ones that aren't held out, marks as toxic."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes that repeat an earlier 100-byte string; n_chars follows."""
    out = suffixes.dedup(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded_sha256, round_trip), a row a document of the mix: its ids, decoded again by the streaming machine and compared."""
    out = bpe.encode(docs.select("doc_id", "source", "text"), *bpe.public_vocabulary(), verified=True)
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("ids_sha256").alias("decoded_sha256"), F.col("ids_same").alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffixes", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A kernel machine, fingerprints by a hash that DuckDB lacks, and a tokenizer: SQL expresses none of them. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
