"""From raw documents to token ids: language, exact copies, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
Every stage defines what it does with nulls, empty texts, ties and repeated rows in its operator's
module; none reads anything but ``docs``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from haptrace.llm import bpe, exact_dedup, langid, mixing, simhash
from haptrace.llm.catalog import BPE_FILE, TARGETS, language_network, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts of no clear language."""
    return langid.keep_known(docs, language_network(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixed(docs, TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, and whether these decode to the text."""
    coded = bpe.encode(docs, BPE_FILE, ids_col="token_ids", restored_col="round_trip")
    return coded.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("token_ids", "round_trip")], "token_ids",
                        F.size("token_ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("tokens", tokens),
]

# Networks, fingerprints and merges are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{_shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a scratch folder only on a local master."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return folder
