"""Text and price features in one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quillbar.operators.align import join_bars
from quillbar.operators.bars import add_indicators
from quillbar.operators.lexicon import all_scores
from quillbar.operators.summary import add_entity_flags, headline_shape

TEXT_FEATURES = [
    "sentiment_polarity", "sentiment_subjectivity", "sentiment_valence", "text_length", "word_count",
    "has_earnings_keywords", "has_merger_keywords", "has_regulatory_keywords",
]
PRICE_FEATURES = ["price_change_1d", "price_change_7d", "volume_ratio", "volatility_7d", "rsi_14d"]


def feature_table(headlines: DataFrame, bars: DataFrame, lexicon: DataFrame, negations: Sequence[str],
                  boosters: dict[str, float], key: str = "headline_id", text: str = "headline",
                  model_scores: DataFrame | None = None) -> DataFrame:
    """One row per headline that has a bar. ``model_scores`` (``key, model_sentiment``) may add the
    score of a caller's own model."""
    known = ["date", "symbol", *[c for c in TEXT_FEATURES if not c.startswith("sentiment_")]]
    shaped = add_entity_flags(headline_shape(headlines, text), text)
    # shape and flags are computed beside the tokens and go through the sums with the key: one scan of the texts
    out = all_scores(shaped, key, text, lexicon, negations, boosters, carry=known).withColumnsRenamed({
        "polarity": "sentiment_polarity", "subjectivity": "sentiment_subjectivity", "compound": "sentiment_valence"})
    if model_scores is not None:
        out = out.join(model_scores.select(key, "model_sentiment"), key, "left")
    priced = add_indicators(bars).select("symbol", "date", *PRICE_FEATURES)
    extra = ["model_sentiment"] if model_scores is not None else []
    return join_bars(out, priced).select(key, "date", "symbol", *TEXT_FEATURES, *extra, *PRICE_FEATURES)
