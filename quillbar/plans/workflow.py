"""From headlines and bars to a comparison of models.

Only keys, prices and labels go through the joins and windows; texts are read where a model needs
them. Labels are materialised once, since the split, the fits and the evaluation all use them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quillbar.functions.fixed_values import LABELS
from quillbar.operators.align import join_bars
from quillbar.operators.bars import label_bars, label_rows
from quillbar.operators.compare import model_comparison
from quillbar.operators.lexicon import polarity, valence, with_tokens
from quillbar.operators.models import (
    NaiveBayes, baseline_majority, baseline_random, fit_logistic, plug_in_scorer, score_logistic,
)
from quillbar.operators.splits import time_split
from quillbar.operators.strategy import predictions_by_day, strategy_metrics
from quillbar.session import materialize

KEY = "headline_id"


def labelled_rows(headlines: DataFrame, bars: DataFrame, horizon: int = 1, threshold: float = 0.02,
                  label_on: str = "headline") -> DataFrame:
    """``headline_id, date, symbol, close, sentiment_label`` for headlines that have a bar and a label.

    ``label_on='headline'`` takes the next headline row of the symbol, which may be of the same
    day; ``'bar'`` takes the next bar.
    """
    keys = headlines.select(KEY, "date", "symbol")
    prices = bars.select("date", "symbol", "close")
    if label_on == "headline":
        rows = label_rows(join_bars(keys, prices), ("date", KEY), horizon, threshold, sample=keys)
    elif label_on == "bar":
        rows = join_bars(keys, label_bars(prices, horizon=horizon, threshold=threshold))
    else:
        raise ValueError("label_on must be 'headline' or 'bar'")
    return rows.where(F.col("sentiment_label").isNotNull()).select(
        KEY, "date", "symbol", "close", "sentiment_label")


def compare_models(headlines: DataFrame, bars: DataFrame, lexicon: DataFrame, negations: Sequence[str],
                   boosters: dict[str, float], models: Sequence[str] = ("polarity", "valence", "logistic", "naive_bayes", "majority"),
                   fractions: Sequence[float] = (0.7, 0.15, 0.15), snap: str = "row", horizon: int = 1,
                   threshold: float = 0.02, label_on: str = "headline", returns_from: str = "rows",
                   scorer: Callable | None = None, **strategy) -> DataFrame:
    """Label, split by time, fit on the training part, score the test part, compare.

    ``returns_from='rows'`` takes strategy returns between consecutive test rows;
    ``'bars'`` first makes one prediction per symbol and day and uses the bars' own returns.
    ``scorer`` is the loader of a caller's model, scored as ``custom``.
    """
    labelled = materialize(labelled_rows(headlines, bars, horizon, threshold, label_on))
    parts = time_split(labelled, "date", KEY, fractions, snap)
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    texts = headlines.select(KEY, "headline")
    # Every text that a model reads is cleaned and tokenized once, however many do; what moves are texts, not their tokens.
    read = texts.join(parts.where("split <> 'val'").select(KEY, "sentiment_label", "split"), KEY)
    tokens = materialize(with_tokens(read, KEY, "headline", carry=["sentiment_label", "split"]))
    train_tokens, test_tokens = tokens.where("split = 'train'"), tokens.where("split = 'test'")
    test_texts = texts.join(test.select(KEY), KEY)

    makers = {
        "polarity": lambda: polarity(test_tokens, KEY, "_tokens", lexicon),
        "valence": lambda: valence(test_tokens, KEY, "_tokens", lexicon, negations, boosters),
        "naive_bayes": lambda: NaiveBayes.fit(train_tokens, "_tokens", "sentiment_label").score(test_tokens, KEY, "_tokens"),
        "logistic": lambda: score_logistic(fit_logistic(train_tokens, "_tokens", "sentiment_label"), test_tokens, KEY),
        "majority": lambda: baseline_majority(train, test, KEY, "sentiment_label"),
        "random": lambda: baseline_random(test, KEY),
        "custom": lambda: plug_in_scorer(test_texts, KEY, "headline", scorer),
    }
    columns = [f"p_{c}" for c in LABELS]

    def keyed(name: str) -> DataFrame:
        scores = makers[name]()
        given = [F.col(c) if c in scores.columns else F.lit(None).cast("double").alias(c) for c in columns]
        return scores.select(F.lit(name).alias("model"), F.col(KEY).alias("row_id"), "y_pred", *given)

    scored = reduce(DataFrame.unionByName, [keyed(m) for m in models])
    answers = test.select(F.col(KEY).alias("row_id"), "date", "symbol", "close", F.col("sentiment_label").alias("y_true"))
    predictions = materialize(scored.join(answers, "row_id"))
    if returns_from == "rows":
        return model_comparison(predictions, answers, **strategy)
    if returns_from != "bars":
        raise ValueError("returns_from must be 'rows' or 'bars'")
    daily = predictions_by_day(predictions)
    return model_comparison(predictions, None).join(
        _bar_strategy(daily, bars, **strategy), "model", "left").orderBy(F.desc("accuracy"), "model")


def _bar_strategy(daily: DataFrame, bars: DataFrame, **strategy) -> DataFrame:
    """Strategy metrics on the bars from the first to the last predicted day; days without a
    prediction hold no position."""
    span = daily.groupBy("model").agg(F.min("date").alias("first"), F.max("date").alias("last")).collect()
    models = F.explode(F.array(*[
        F.struct(F.lit(r["model"]).alias("model"), F.lit(r["first"]).alias("first"), F.lit(r["last"]).alias("last"))
        for r in span]))
    calendar = bars.select("symbol", "date", "close", models.alias("_m")).where(
        F.col("date").between(F.col("_m.first"), F.col("_m.last"))).select("symbol", "date", "close", "_m.model")
    rows = calendar.join(daily, ["model", "symbol", "date"], "left").withColumn(
        "y_pred", F.coalesce("y_pred", F.lit("neutral")))
    options = {"order_by": ("date", "symbol"), "scope": "date", "daily": True, **strategy}
    return strategy_metrics(rows, **options).drop("n_rows", "sharpe_simple")
