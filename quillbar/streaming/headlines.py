"""The row-wise text operators on a stream of headlines. They keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillbar.functions.text import clean_text
from quillbar.operators.summary import add_entity_flags


def tag_stream(headlines: DataFrame, text: str = "headline") -> DataFrame:
    """Add the cleaned text and the six flags to a streaming (or batch) DataFrame."""
    return add_entity_flags(headlines, text).withColumn(f"{text}_clean", clean_text(F.col(text)))
