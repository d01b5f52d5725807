"""A corpus pipeline over ``documents``: each stage's rows are written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns them without those it decides against, columns as they
came; the last returns the packed pieces.  How nulls, empty and long texts, repeated rows and empty tables are treated
is stated in each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from idlespan.llm import elias_fano, exact_dedup, kneser_ney, raking, simhash, vector_fit
from idlespan.llm.store import saved, table

#: Words whose ids a packing worker keeps: it stands beside what the stages before have left in its executor.
WORDS = 200_000

def keep_good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of the trusted ones passes their language's threshold."""
    return kneser_ney.keep_accepted(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 over five-word shingles the smallest doc_id stays."""
    return simhash.keep_one_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, drawn towards flatter source, language and topic shares."""
    return raking.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return vector_fit.pack_documents(docs, elias_fano.tokenizer_path("word_bpe_49k.json"), False, memory=WORDS)


STAGES = [("quality", keep_good_text), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
