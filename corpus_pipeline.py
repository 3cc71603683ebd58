"""A training corpus in five stages; each works on all that the one before it kept.

``run`` applies STAGES to ``documents``. The labels and the benchmark come from
``sf_dir``. All stages but the last return the columns they were given, and
further columns pass through whatever their names. Null and blank texts are
empty ones. Ids are integers and should be unique: rows that share one share
each decision, so equal rows of one id stay together. Rows without an id are
never rejected. Empty tables give empty tables; without labelled documents no
document is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, decontam, exact, near, toxicity
from folioflow.llm.store import stored

TOXIC = 0.5
RANKS = "byte_bpe_multi_50k.tiktoken"


#: Ids of rejected documents are broadcast up to this many; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't in found; rows without an id stay."""
    ids = stored(found.select("doc_id").distinct(), "rejected")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC. Scores come from labels of all folds: none is held out here."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not len(model[0]):  # no labelled document: nothing is known to be toxic
        return docs
    return _without(docs, toxicity.score(docs, model).filter(F.col("score") >= TOXIC))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest id."""
    return _without(docs, exact.exact_duplicates(docs).filter(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (Jaccard 0.8 of 5-word shingles), that of the smallest id."""
    return _without(docs, near.near_copies(docs).filter("doc_id != component_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode(docs, bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", tokenize),
]

#: SQL can express neither the fitted classifier nor the latent search; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
