"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it
as Parquet in the shared folder and hands the reread table to the next stage.
All but the last return the columns of `documents`.

Rows that the stages meet outside the ordinary: a null or empty text passes
toxicity and line dedup, is no near duplicate of anything, has no words to mix
and so leaves with the copies that are certain in its source, often none; repeated
rows count as near duplicates, and one stays; rows of one identifier with different
texts are judged by their texts; very long texts are read whole; extra columns are
carried, whatever their names; empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import line_dedup, mixing, ngram_join, packing, toxicity
from inkspan.llm.common import fold, read, remove, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score reaches the threshold; models learn as in op4."""
    scorer = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = scorer.score(docs.select(row, F.col("text").cast("string").alias("text")))
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out all but one line of each group of near-duplicate lines."""
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: shingles of five words, similar from 0.8."""
    return ngram_join.keep_one(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of sources does."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the token sequences of all documents in sequences of one length."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Models, MinHash and tokenizers have no SQL; tests hold the stages against brute force where they have one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and reread.

    A stage's table is removed when the next one is written; the last stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
