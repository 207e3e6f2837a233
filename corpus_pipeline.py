"""A training corpus from raw documents, in five stages. Each takes the documents that its predecessor kept.

SQL can't express the first stage's fit or the last one's sampling; tests hold the stages against brute force.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.llm import mixing, ngram_join, piece_sampling, quality, suffix_dedup
from talkgrain.llm.common import Scratch, table
from talkgrain.session import ship

ORACLE_SQL = None


def shipped(stage):
    """The stage, run once the executors' Python workers can import what it needs."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


@shipped
def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@shipped
def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one of the smallest doc_id stays."""
    return ngram_join.keep_first(docs, Scratch(spark, "near"))


@shipped
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: text loses strings of 400 bytes or more and passages of over 50 words that start elsewhere, too; no document goes."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = suffix_dedup.remove_repeats(docs, Scratch(spark, "passages"), keep=rest)
    return out.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*docs.columns)


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for each copy that the mix takes, in the order of training."""
    return mixing.mixed_documents(docs, Scratch(spark, "mix"))


@shipped
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: doc_id, n_pieces and ids of each row."""
    return piece_sampling.encoded(docs, piece_sampling.load(), digest=False)


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared folder and read again as the next one's documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
