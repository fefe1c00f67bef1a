"""Regression errors, bootstrap intervals and tests between models.

Resampling and time-series tests work on one row per unit (normally a date), which is bounded by
the calendar; raw rows are summed up per unit first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillbar.functions.numeric import ratio, uniform
from quillbar.session import shuffle_width

MOST_ROWS = 1_000_000

# Cumulative Poisson(1) probabilities for 0, 1, 2, ... draws, until they are 1 in double precision.
POISSON_STEPS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(18)]


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """``mse, rmse, mae, r2, mape`` over the rows that have both values."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    error = F.col(actual) - F.col(predicted)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(actual).alias("_var"),
        F.avg(F.abs(ratio(error, F.col(actual)))).alias("mape"),
    )
    return out.withColumn("r2", 1 - ratio(F.col("mse"), F.col("_var"))).drop("_var")


def poisson_weight(u: Column) -> Column:
    """The Poisson(1) draw that belongs to a uniform number."""
    out = F.lit(0)
    for step in POISSON_STEPS:
        out = out + (u >= step).cast("int")
    return out


def replicate_units(units: DataFrame, unit: str, replicates: int, seed: int = 42) -> DataFrame:
    """Each unit once per replicate with its weight (0 for units not drawn).

    The few units are spread over all tasks first, since each becomes ``replicates`` rows. A unit that is not few
    by nature (a row id, say) raises beyond MOST_ROWS of units.
    """
    if units.count() > MOST_ROWS:
        raise ValueError(f"{unit} has more than {MOST_ROWS} rows of units: take a coarser unit, such as a date")
    spread = units.repartition(shuffle_width(units.sparkSession), unit)
    copies = spread.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = copies.withColumn("_u", uniform(seed, "boot", F.col("replicate"), F.col(unit)))
    return drawn.withColumn("_w", poisson_weight(F.col("_u"))).drop("_u")


def bootstrap_ci(df: DataFrame, value: str, unit: str, by: Sequence[str] = ("model",), replicates: int = 1000,
                 alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """``by, mean, low, high``: mean of ``value`` with its bootstrap interval.

    Units (say, dates) are redrawn whole with Poisson(1) weights, the same draw for every group.
    """
    units = df.groupBy(*by, unit).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(value).alias("_n"))
    means = replicate_units(units, unit, replicates, seed).groupBy(*by, "replicate").agg(
        ratio(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("_m"))
    ends = means.groupBy(*by).agg(
        F.percentile("_m", F.lit(alpha / 2)).alias("low"), F.percentile("_m", F.lit(1 - alpha / 2)).alias("high"))
    point = units.groupBy(*by).agg(ratio(F.sum("_s"), F.sum("_n")).alias("mean"))
    return point.join(ends, list(by)) if by else point.withColumns({
        "low": ends.select("low").scalar(), "high": ends.select("high").scalar()})


def paired_t(df: DataFrame, value: str, row: str, base: str, others: Sequence[str], model: str = "model") -> DataFrame:
    """``model, n, mean_diff, t``: paired t statistic of each model against ``base``."""
    wide = df.groupBy(row).agg(*[
        F.max(F.when(F.col(model) == m, F.col(value).cast("double"))).alias(f"_m{i}") for i, m in enumerate([base, *others])])
    diffs = wide.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), (F.col(f"_m{i}") - F.col("_m0")).alias("_d")) for i, m in enumerate(others, 1)])))
    out = diffs.where(F.col("_d").isNotNull()).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("_sd"))
    return out.withColumn("t", ratio(F.col("mean_diff"), F.col("_sd") / F.sqrt(F.col("n")))).drop("_sd")


def daily_differential(df: DataFrame, loss: str, base: str, others: Sequence[str], date: str = "date",
                       model: str = "model") -> DataFrame:
    """``model, date, d``: mean loss of ``base`` less mean loss of the model, per date with both."""
    per_day = df.groupBy(date).agg(*[
        F.avg(F.when(F.col(model) == m, F.col(loss).cast("double"))).alias(f"_m{i}") for i, m in enumerate([base, *others])])
    rows = per_day.select(date, F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), (F.col("_m0") - F.col(f"_m{i}")).alias("d")) for i, m in enumerate(others, 1)])))
    return rows.where(F.col("d").isNotNull())


def diebold_mariano(differential: DataFrame, date: str = "date", lags: int = 4) -> DataFrame:
    """``model, n, mean_diff, dm``: mean differential over its standard error, with Bartlett
    weights on the first ``lags`` autocovariances."""
    whole = Window.partitionBy("model")
    spec = whole.orderBy(date)
    centred = differential.withColumn("_c", F.col("d") - F.avg("d").over(whole))
    products = centred.withColumns({f"_p{k}": F.col("_c") * (F.lag("_c", k).over(spec) if k else F.col("_c"))
                                    for k in range(lags + 1)})
    sums = products.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"),
        *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(lags + 1)])
    spread = F.col("_s0")
    for k in range(1, lags + 1):
        spread = spread + 2 * (1 - k / (lags + 1)) * F.col(f"_s{k}")
    return sums.select("model", "n", "mean_diff", F.when(
        spread > 0, F.col("mean_diff") / F.sqrt(spread / F.col("n") / F.col("n"))).alias("dm"))


def reality_check(differential: DataFrame, date: str = "date", replicates: int = 1000, seed: int = 42) -> DataFrame:
    """``statistic, p_value``: whether the best model beats the base beyond luck.

    The statistic is the largest scaled mean differential; the p-value is the share of bootstrap
    replicates (dates redrawn, means centred) that reach it.
    """
    points = differential.groupBy("model").agg(F.avg("d").alias("_mean"), F.count(F.lit(1)).alias("_t"))
    observed = points.agg(F.max(F.sqrt("_t") * F.col("_mean")).alias("statistic"))
    drawn = replicate_units(differential, date, replicates, seed).groupBy("model", "replicate").agg(
        ratio(F.sum(F.col("_w") * F.col("d")), F.sum("_w").cast("double")).alias("_m"))
    best = drawn.join(points, "model").groupBy("replicate").agg(
        F.max(F.sqrt("_t") * (F.col("_m") - F.col("_mean"))).alias("_v"))
    tested = best.withColumn("statistic", observed.scalar())
    return tested.agg(F.max("statistic").alias("statistic"),
                      F.avg((F.col("_v") >= F.col("statistic")).cast("double")).alias("p_value"))
