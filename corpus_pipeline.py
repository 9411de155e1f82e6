"""From raw documents to an encoded training mix, in five stages.

Each stage takes the documents that the one before it kept, and its decisions
take effect on them: quality drops documents, line dedup shortens texts,
near-dedup keeps one document of each group, mixing repeats and cuts documents
to their sources' budgets, and encoding turns the mix into tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetspark.llm import bpe, linededup, mixing, quality, simhash
from vetspark.llm.common import materialise, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels, doesn't reject."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of runs of lines of 50 words or more; all documents stay."""
    return linededup.drop_repeated_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked where 5-word shingles are 0.8 alike or more; emptied texts are one group."""
    return simhash.keep_one_similar(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them, cut at each source's budget."""
    return mixing.take_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every document of the mix: doc_id, n_tokens, ids."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: The quality model is learnt from data, which SQL can't express; tests compare every stage with brute force, or with SQL over what the stage before it kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: (doc_id, n_tokens, ids_sha256), a row for every document of the mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = materialise(docs, f"stage-{name}")
    return docs.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
