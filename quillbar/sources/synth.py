"""Generated headlines and bars.

All randomness is a hash of the seed and the row's own key: the same seed gives the same rows
however the table is partitioned, and a lost task redraws exactly what it drew before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillbar.functions import fixed_values as fixed
from quillbar.functions.numeric import hash_int, normal, ratio, uniform
from quillbar.operators.bars import add_indicators
from quillbar.operators.summary import headline_shape


def _pick(values: Sequence[str], *parts) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (hash_int(*parts) % len(values)).cast("int"))


def _label(draw: Column, shares: dict[str, float]) -> Column:
    return (
        F.when(draw < shares["positive"], "positive")
        .when(draw < shares["positive"] + shares["neutral"], "neutral")
        .otherwise("negative")
    )


def synth_headlines(ids: DataFrame, symbols: Sequence[str] = tuple(fixed.SYMBOLS), start: str = fixed.START_DATE,
                    end: str = fixed.END_DATE, shares: dict[str, float] = fixed.LABEL_SHARES,
                    keywords: dict[str, list[str]] = fixed.KEYWORDS, seed: int = 42) -> DataFrame:
    """One generated headline per row of ``ids`` (column ``headline_id``); see also ``headline_ids``."""
    key = F.col("headline_id")
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    drawn = ids.select(
        key,
        F.date_add(F.lit(start).cast("date"), (hash_int(seed, "date", key) % days).cast("int")).alias("date"),
        _pick(symbols, seed, "symbol", key).alias("symbol"),
        _label(uniform(seed, "label", key), shares).alias("sentiment_label"),
    )
    label = F.col("sentiment_label")

    def by_label(make) -> Column:
        return F.when(label == "positive", make("positive")).when(label == "negative", make("negative")).otherwise(
            make("neutral"))

    pattern = by_label(lambda c: _pick(fixed.TEMPLATES[c], seed, "template", key))
    keyword = by_label(lambda c: _pick(keywords[c], seed, "keyword", key))
    base = F.replace(F.replace(pattern, F.lit("{k}"), keyword), F.lit("{s}"), F.col("symbol"))
    focus = F.when(uniform(seed, "focus", key) < fixed.FOCUS_SHARE,
                   F.concat(F.lit(" with focus on "), _pick(fixed.FOCUS_TERMS, seed, "term", key))).otherwise("")
    written = drawn.withColumn("headline", F.concat(base, focus))
    return headline_shape(written).select(
        "headline_id", "date", "symbol", "headline", "sentiment_label", "text_length", "word_count")


def headline_ids(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(rows).withColumnRenamed("id", "headline_id")


def calendar(spark: SparkSession, symbols: Sequence[str] = tuple(fixed.SYMBOLS), start: str = fixed.START_DATE,
             end: str = fixed.END_DATE) -> DataFrame:
    """Every (symbol, day) of the range, both ends included."""
    names = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    return names.withColumn("date", F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))))


def synth_bars(days: DataFrame, base_price: float = fixed.BASE_PRICE, drift: float = fixed.DRIFT,
               volatility: float = fixed.VOLATILITY, jump_probability: float = fixed.JUMP_PROBABILITY,
               jump_size: float = fixed.JUMP_SIZE, seed: int = 42, impact: DataFrame | None = None) -> DataFrame:
    """One generated bar per row of ``days`` (unique ``symbol, date``).

    The price path is a running product of daily steps. ``impact`` (``symbol, date, impact``)
    multiplies the step of that day by ``1 + impact``.
    """
    by_day = Window.partitionBy("symbol").orderBy("date")
    key = (F.col("symbol"), F.col("date"))
    step_size = 1.0 / fixed.TRADING_DAYS
    walk = F.exp(F.lit((drift - 0.5 * volatility ** 2) * step_size)
                 + volatility * (step_size ** 0.5) * normal(seed, "walk", *key))
    jump = F.when(uniform(seed, "jump", *key) < jump_probability, 1 + jump_size * normal(seed, "size", *key)).otherwise(1.0)
    numbered = days.select("symbol", "date").withColumns({
        "_i": F.row_number().over(by_day) - 1,
        "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol")),
    })
    push = F.lit(1.0)
    if impact is not None:
        numbered = numbered.join(impact.select("symbol", "date", "impact"), ["symbol", "date"], "left")
        push = 1 + F.coalesce(F.col("impact"), F.lit(0.0))
    stepped = numbered.withColumn("_step", F.when(F.col("_i") == 0, 1.0).otherwise(walk * jump * push))
    priced = stepped.withColumn("_close", base_price * F.product("_step").over(
        by_day.rowsBetween(Window.unboundedPreceding, 0)))
    close = F.col("_close")
    opened = priced.withColumn("_open", close * (1 + fixed.OPEN_SPREAD * normal(seed, "open", *key)))
    upper = 1 + F.abs(fixed.WICK_SPREAD * normal(seed, "high", *key))
    lower = 1 - F.abs(fixed.WICK_SPREAD * normal(seed, "low", *key))
    trend = F.coalesce(ratio(fixed.VOLUME_GROWTH * F.col("_i"), F.col("_n") - 1), F.lit(0.0))
    season = fixed.VOLUME_SWING * F.sin(2 * F.pi() * F.col("_i") / fixed.TRADING_DAYS)
    volume = fixed.BASE_VOLUME * (1 + trend + season + fixed.VOLUME_NOISE * normal(seed, "volume", *key))
    return opened.select(
        "date", "symbol",
        F.round("_open", 2).alias("open"),
        F.round(F.greatest("_open", "_close") * upper, 2).alias("high"),
        F.round(F.least("_open", "_close") * lower, 2).alias("low"),
        F.round("_close", 2).alias("close"),
        F.greatest(volume, F.lit(float(fixed.VOLUME_FLOOR))).cast("long").alias("volume"),
    )


def synth_bars_indicators(days: DataFrame, **options) -> DataFrame:
    return add_indicators(synth_bars(days, **options))


def sentiment_impact(headlines: DataFrame, size: float = fixed.SENTIMENT_IMPACT, lag_days: int = 1) -> DataFrame:
    """``symbol, date, impact``: the day's mean label (-1, 0, 1) times ``size``, ``lag_days`` later."""
    label = F.col("sentiment_label")
    score = F.when(label == "positive", 1.0).when(label == "negative", -1.0).otherwise(0.0)
    return headlines.groupBy("symbol", F.date_add("date", lag_days).alias("date")).agg(
        (F.avg(score) * size).alias("impact"))


def synth_dataset(spark: SparkSession, rows: int = 10_000, symbols: Sequence[str] = tuple(fixed.SYMBOLS),
                  start: str = fixed.START_DATE, end: str = fixed.END_DATE, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Headlines and bars with the default settings."""
    return (synth_headlines(headline_ids(spark, rows), symbols, start, end, seed=seed),
            synth_bars(calendar(spark, symbols, start, end), seed=seed))
