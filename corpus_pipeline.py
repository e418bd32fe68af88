"""Training-corpus pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, packing.

Each stage takes what its predecessor kept, written as Parquet and read again.  All but the last return the
columns of ``documents``; an id that a filtering stage rejects is gone with all its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtable.llm.decontamination import find_leaks
from voxtable.llm.exact_dedup import exact_duplicates
from voxtable.llm.near_dedup import near_duplicates
from voxtable.llm.packing import pack
from voxtable.llm.queries import fold
from voxtable.llm.tokens import tokenizer_path
from voxtable.llm.toxicity import CUT, learn, score_toxicity
from voxtable.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the cut; null and empty texts score like texts without a hit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    terms, weights = learn(docs, labels.filter(fold(3) != 1))
    return score_toxicity(docs, terms, weights, out="toxic_score").filter(F.col("toxic_score") < CUT).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; rows without an id cannot be compared and stay."""
    dropped = exact_duplicates(docs).filter("not kept").select("doc_id")
    return docs.join(dropped.distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies."""
    dropped = near_duplicates(docs).filter("not kept").select("doc_id")
    return docs.join(dropped.distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    leaked = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), blank_in_word=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_documents),
]

#: Toxicity, tokenizing and packing cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
