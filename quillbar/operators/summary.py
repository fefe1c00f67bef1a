"""Shape, preview, sample and overview of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillbar.functions.numeric import hash_int
from quillbar.functions.text import entity_flags, preprocess_text, text_length, word_count

HASH_RANGE = 1 << 32


def headline_shape(df: DataFrame, text: str = "headline") -> DataFrame:
    return df.withColumns({"text_length": text_length(F.col(text)), "word_count": word_count(F.col(text))})


def preprocess(df: DataFrame, text: str, into: str | None = None, **options) -> DataFrame:
    """Add the processed text, by default as ``<text>_processed``."""
    return df.withColumn(into or f"{text}_processed", preprocess_text(F.col(text), **options))


def add_entity_flags(df: DataFrame, text: str = "headline", match: str = "substring") -> DataFrame:
    lowered = df.withColumn("_lower", F.lower(F.col(text)))
    return lowered.withColumns(entity_flags(F.col(text), F.col("_lower"), match)).drop("_lower")


def preview(df: DataFrame, columns: list[str], order: list[str], rows: int = 10) -> DataFrame:
    return df.select(*columns).orderBy(*order).limit(rows)


def sample_rows(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """A seeded sample of fixed size without replacement: the rows with the smallest hashes.

    A threshold on the hash that leaves about four times the rows wanted goes in front, so that the tasks send few rows
    each; where it leaves too few, it is not used.
    """
    hashed = df.withColumn("_hash", hash_int(seed, F.col(key)))
    total = df.count()
    if total > 8 * rows:
        low = hashed.where(F.col("_hash") < HASH_RANGE * 4 * rows // total)
        if low.count() >= rows:
            hashed = low
    return hashed.orderBy("_hash", key).limit(rows).drop("_hash")


def label_distribution(df: DataFrame, label: str = "sentiment_label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def dataset_overview(df: DataFrame, text: str = "headline") -> DataFrame:
    """Rows, symbols, first and last day, mean text length.

    Counts are taken per (symbol, date) first, so the distinct count never sees the raw rows.
    """
    days = df.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(F.char_length(text)).alias("_chars"), F.count(text).alias("_texts"))
    return days.agg(
        F.sum("_rows").alias("n_rows"),
        F.countDistinct("symbol").alias("n_symbols"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        (F.sum("_chars") / F.sum("_texts")).alias("mean_text_length"),
    )
