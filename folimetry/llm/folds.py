"""Labelled rows: which are held out, and the bounded sample that models are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a model is fitted on at most: those of smallest hash, so that the choice depends on nothing else.
SAMPLE_ROWS = 16_000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of the identifier as text is 0 modulo 5; null identifiers aren't held out (and have no labels)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents outside the held-out fold."""
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return texts_of(docs, chosen)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen(doc_id, ...), a bounded list that is broadcast, with a text of docs for each row: of a repeated identifier the
    first text in order, so that the result isn't longer than the list."""
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return met.groupBy(*chosen.columns).agg(F.min("text").alias("text"))
