"""Corpus pipeline: quality filter, exact and near dedup, mixing to source weights, and encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents. The mix
repeats a document's row as often as it takes it; the last stage has token ids and their decoded text in place of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folimetry.llm.exact_dedup import dedup_stage
from folimetry.llm.ngram_join import near_dedup_stage
from folimetry.llm.quality import quality_stage
from folimetry.llm.scratch import shared_folder, written
from folimetry.llm.sentence_pieces import encode_stage
from folimetry.llm.source_mix import mix_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing sources to target weights", mix_stage),
    ("SentencePiece encoding and decoding", encode_stage),
]
#: A trained classifier and token ids are no SQL; tests hold the stages and run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder)
    return docs
