"""The training-data pipeline: language ID, exact dedup, n-gram Jaccard join, mixing, SentencePiece encoding.

Each stage works on all that its predecessor kept, is written as Parquet and read again.  All but the last return the
columns of documents; the last returns the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import exact_dedup, language_id, mixing, ngram_join, piece_codec
from facetry.llm.common import table, written

#: A text goes if it has no letter or if its language holds less than this share of its letters.
LEAST_SHARE = 0.35


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language; a null lang is filled in."""
    model = language_id.fit(docs.where(~language_id.held_out(3)))
    own = {f"__{i}": docs[c] for i, c in enumerate(docs.columns)}  # whatever the columns are called
    found = language_id.identify(docs, model, carry=own)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.select(*[(F.coalesce(n, "lang_pred") if c == "lang" else F.col(n)).alias(c) for n, c in zip(own, docs.columns, strict=True)])


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs, k=5, num=80, den=100)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.codec(docs)


STAGES = [
    ("language_id", stage_language_id), ("exact_dedup", stage_exact_dedup), ("ngram_join", stage_ngram_join), ("mixing", stage_mixing),
    ("sentencepiece", stage_sentencepiece),
]

#: Language ID, the signature trees and the piece trie have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
