"""All models side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillbar.operators.classify import (
    CLASS_METRICS, MAIN_METRICS, RANK_METRICS, classification_metrics, metrics_long,
)
from quillbar.operators.strategy import STRATEGY_METRICS, strategy_metrics

# Order of the metrics in a report.
REPORT_METRICS = MAIN_METRICS + [
    "total_return", "annualized_return", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "hit_rate",
]


def model_comparison(predictions: DataFrame, market: DataFrame | None = None, probabilities: bool = True,
                     **strategy) -> DataFrame:
    """One row per model: classification metrics and, given ``market``, strategy metrics.

    ``predictions`` has ``model, row_id, y_true, y_pred`` (and ``p_*``); ``market`` has
    ``row_id, date, symbol, close``. Every model is evaluated in the same job.
    """
    out = classification_metrics(predictions, ("model",), probabilities)
    if market is not None:
        rows = predictions.select("model", "row_id", "y_pred").join(
            market.select("row_id", "date", "symbol", "close"), "row_id")
        out = out.join(strategy_metrics(rows, **strategy).drop("n_rows", "sharpe_simple"), "model", "left")
    return out.orderBy(F.desc("accuracy"), "model")


def report(comparison: DataFrame) -> DataFrame:
    """The report's metrics as rows."""
    present = [m for m in REPORT_METRICS if m in comparison.columns]
    return metrics_long(comparison, present)


__all__ = ["CLASS_METRICS", "RANK_METRICS", "STRATEGY_METRICS", "REPORT_METRICS", "model_comparison", "report"]
