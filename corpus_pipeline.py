"""A training corpus from documents: language, quality, near-duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.session import discard, saved_at
from gridloom.llm import langid, mixing, pieces, quality, simhash
from gridloom.llm.common import free_name, table
from gridloom.llm.queries import SOURCE_WEIGHTS, _piece_digests


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts."""
    found = free_name(docs, "language")
    model = langid.fit_language_model(docs)
    return docs.withColumn(found, langid.language(docs, F.col("text"), model)).where(~F.col(f"{found}.rejected")).drop(found)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep."""
    judged = free_name(docs, "quality")
    model = quality.fit_quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn(judged, quality.quality(docs, F.col("text"), model)).where(F.col(f"{judged}.kept")).drop(judged)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least id. Near means SimHashes of the distinct
    five-word shingles with at most 24 of 128 bits apart, so a similarity of some 0.8; all such pairs count. README has the
    recall."""
    return simhash.keep_one_of_each(docs, **simhash.SIMILAR)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled."""
    mixed, copy, order = mixing.mix_sources(docs, "source", SOURCE_WEIGHTS)
    return mixed.drop(copy, order)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return _piece_digests(pieces.PieceCodec(spark, public_tokenizers.path("piece_bpe_32k.model")), docs)


STAGES = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("source mix", mixing_stage),
    ("SentencePiece", token_stage),
]
#: Trained stages can't be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each result is stored before the next stage reads it, and goes when the one after
    that is stored."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs, path = saved_at(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if before is not None:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
