"""Classification metrics for many models at once.

All but the two ranking metrics come from one count per (model, true, predicted) label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillbar.functions.fixed_values import LABELS
from quillbar.functions.numeric import ratio
from quillbar.operators.ordered import RowOrder
from quillbar.session import materialize

MAIN_METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"]
CLASS_METRICS = [f"{m}_{c}" for c in LABELS for m in ("precision", "recall", "f1")]
RANK_METRICS = ["auc_roc", "auc_pr"]


def checked(predictions: DataFrame, mode: str = "strict") -> DataFrame:
    """Rows whose labels are known. ``strict`` raises at run time on any other label."""
    known = F.col("y_true").isin(LABELS) & F.col("y_pred").isin(LABELS)
    known = F.coalesce(known, F.lit(False))
    if mode == "permissive":
        return predictions.where(known)
    if mode != "strict":
        raise ValueError("mode must be 'strict' or 'permissive'")
    problem = F.concat(F.lit("unknown label: "), F.coalesce("y_true", F.lit("null")), F.lit(" / "),
                       F.coalesce("y_pred", F.lit("null")))
    return predictions.where(F.when(known, True).otherwise(F.raise_error(problem).cast("boolean")))


def label_counts(predictions: DataFrame, by: Sequence[str] = ("model",), mode: str = "strict") -> DataFrame:
    """The confusion matrix as a long table: ``by, y_true, y_pred, n``."""
    return checked(predictions, mode).groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, by: Sequence[str] = ("model",), mode: str = "strict") -> DataFrame:
    """One row per true label that occurs, one column per predicted label."""
    counts = label_counts(predictions, by, mode)
    return counts.groupBy(*by, "y_true").agg(*[
        F.coalesce(F.sum(F.when(F.col("y_pred") == c, F.col("n"))), F.lit(0)).alias(f"pred_{c}") for c in LABELS])


def _mean_present(values: list[Column]) -> Column:
    """Mean over the classes that occur (the others are NULL)."""
    total, count = F.lit(0.0), F.lit(0)
    for v in values:
        total = total + F.coalesce(v, F.lit(0.0))
        count = count + v.isNotNull().cast("int")
    return ratio(total, count)


def count_metrics(counts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, macro, weighted and per-class metrics from ``label_counts``.

    A class counts as present if it occurs among true or predicted labels; an absent class has
    NULL metrics and no part in the macro means. A zero denominator gives 0.
    """
    true, pred, n = F.col("y_true"), F.col("y_pred"), F.col("n")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    wide = counts.groupBy(*by).agg(
        F.sum(n).alias("n"),
        total(true == pred).alias("_hit"),
        *[total((true == c) & (pred == c)).alias(f"_tp_{c}") for c in LABELS],
        *[total(true == c).alias(f"_true_{c}") for c in LABELS],
        *[total(pred == c).alias(f"_pred_{c}") for c in LABELS],
    )
    metrics: dict[str, Column] = {}
    for c in LABELS:
        tp, support, predicted = F.col(f"_tp_{c}"), F.col(f"_true_{c}"), F.col(f"_pred_{c}")
        present = (support + predicted) > 0
        metrics[f"precision_{c}"] = F.when(present, F.coalesce(ratio(tp, predicted), F.lit(0.0)))
        metrics[f"recall_{c}"] = F.when(present, F.coalesce(ratio(tp, support), F.lit(0.0)))
        metrics[f"f1_{c}"] = F.when(present, F.coalesce(ratio(2 * tp, support + predicted), F.lit(0.0)))
    out = wide.withColumns(metrics)
    weighted = sum(F.coalesce(F.col(f"f1_{c}"), F.lit(0.0)) * F.col(f"_true_{c}") for c in LABELS)
    out = out.withColumns({
        "accuracy": ratio(F.col("_hit"), F.col("n")),
        **{f"{m}_macro": _mean_present([F.col(f"{m}_{c}") for c in LABELS]) for m in ("precision", "recall", "f1")},
        "f1_weighted": ratio(weighted, F.col("n")),
    })
    return out.select(*by, "n", *MAIN_METRICS, *CLASS_METRICS)


def rank_metrics(predictions: DataFrame, by: Sequence[str] = ("model",), mode: str = "strict", **layout) -> DataFrame:
    """``auc_roc`` (one against the rest) and ``auc_pr`` (average precision), means of the classes.

    Rows collapse to one per distinct score first; running totals over the scores then need no
    task to hold a whole model. NULL unless every class occurs among the true labels.
    """
    per_class = F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("score"),
                 (F.col("y_true") == c).cast("int").alias("hit")) for c in LABELS]))
    scores = (
        checked(predictions, mode=mode).select(*by, per_class.alias("_s")).select(*by, "_s.*")
        .groupBy(*by, "class", "score")
        .agg(F.sum("hit").alias("pos"), (F.count(F.lit(1)) - F.sum("hit")).alias("neg"))
        .withColumn("_down", -F.col("score"))
    )
    scores = materialize(scores)
    order = RowOrder((*by, "class"), ("_down",), **layout)
    ranked = order.running_sum(scores, {"pos": "cum_pos", "neg": "cum_neg"})
    # Per score: negatives ranked strictly above it, and half of those equal to it, are pairs lost.
    lost = F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    sums = ranked.groupBy(*by, "class").agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_q"), F.sum(lost).alias("_lost"),
        F.sum(precision * F.col("pos")).alias("_area"))
    each = sums.select(
        *by, "class",
        (1 - ratio(F.col("_lost"), F.col("_p") * F.col("_q"))).alias("roc"),
        ratio(F.col("_area"), F.col("_p")).alias("pr"))
    full = F.count("roc") == len(LABELS)
    return each.groupBy(*by).agg(
        F.when(full, F.avg("roc")).alias("auc_roc"), F.when(full, F.avg("pr")).alias("auc_pr"))


def classification_metrics(predictions: DataFrame, by: Sequence[str] = ("model",), probabilities: bool = True,
                           mode: str = "strict") -> DataFrame:
    out = count_metrics(label_counts(predictions, by, mode), by)
    if not probabilities:
        return out
    scored = predictions.where(" and ".join(f"p_{c} is not null" for c in LABELS))
    return out.join(rank_metrics(scored, by, mode), list(by), "left")


def metrics_long(metrics: DataFrame, names: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """``by, position, metric, value`` in the order of ``names``; missing values are left out."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for i, m in enumerate(names)])
    return metrics.select(*by, F.inline(cells)).where(F.col("value").isNotNull())


def metrics_matrix(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The 3 x 3 matrix as nested arrays, rows true and columns predicted."""
    cells = label_counts(predictions, by).groupBy(*by).agg(*[
        F.coalesce(F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), F.col("n"))), F.lit(0)).alias(f"_{i}{j}")
        for i, t in enumerate(LABELS) for j, p in enumerate(LABELS)])
    return cells.select(*by, F.array(*[
        F.array(*[F.col(f"_{i}{j}") for j in range(3)]) for i in range(3)]).alias("confusion_matrix"))
