"""Headlines and bars side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillbar.operators.ordered import SMALLEST_SAMPLE, RowOrder


def join_bars(headlines: DataFrame, bars: DataFrame) -> DataFrame:
    """Each headline with the bar of its symbol and day; headlines without one are dropped.

    Bars have one row per (date, symbol). The planner broadcasts them when they are small;
    otherwise the join shuffles on both columns, and adaptive execution splits a symbol-day that
    holds a large share of the headlines.
    """
    return headlines.join(bars, ["date", "symbol"], "inner")


def daily_score(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean score per symbol and day."""
    return scores.groupBy("symbol", "date").agg(F.avg(score).alias("sentiment"))


def overlay(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Each bar with the day's mean sentiment, NULL where there is none."""
    return bars.join(daily, ["symbol", "date"], "left")


def _calendar(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Bars and sentiment days in one table: at most one row per symbol and day."""
    return bars.withColumn("_is_bar", F.lit(True)).join(daily, ["symbol", "date"], "full")


def asof(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Each bar with the last sentiment known on or before its day."""
    spec = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        _calendar(bars, daily)
        .withColumn("sentiment", F.last("sentiment", ignorenulls=True).over(spec))
        .where("_is_bar").drop("_is_bar")
    )


def interpolate(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Each bar with the sentiment on the straight line between the days around it.

    Before the first and after the last known day the nearest known value holds.
    """
    earlier = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead is looking back in falling order: a frame that only grows is computed in one pass
    later = Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("sentiment").isNotNull(), F.struct("date", "sentiment"))
    located = (
        _calendar(bars, daily).withColumn("_point", point)
        .withColumns({"_a": F.last("_point", ignorenulls=True).over(earlier),
                      "_b": F.last("_point", ignorenulls=True).over(later)})
        .where("_is_bar")
    )
    a, b = F.col("_a"), F.col("_b")
    share = F.datediff("date", a["date"]) / F.datediff(b["date"], a["date"])
    value = (
        F.when(a.isNull(), b["sentiment"]).when(b.isNull(), a["sentiment"])
        .when(a["date"] == b["date"], a["sentiment"])
        .otherwise(a["sentiment"] + (b["sentiment"] - a["sentiment"]) * share)
    )
    return located.withColumn("sentiment", value).drop("_is_bar", "_point", "_a", "_b")


def asof_ticks(ticks: DataFrame, points: DataFrame, value: str = "value", key: str = "symbol", time: str = "ts", tick: str = "row_id",
               point: str = "point_id", into: str | None = None, strict: bool = False, within: float | None = None,
               ranges: int | None = None, smallest_sample: int = SMALLEST_SAMPLE) -> DataFrame:
    """Ticks with the last ``value`` of ``points`` of their key at or before their time stamp, and ``age_seconds``, how long it is known.

    Both tables are merged and cut at common ranges of (key, time), so that a key with a large share of all rows is many
    ranges; the last value of a range is carried into the next ones. ``strict`` leaves points of the very time stamp out; ``within`` drops values
    older than so many seconds. Of points at one time stamp the last by ``point`` counts. ``tick`` and ``point`` are ids of one type. Points without key
    or time are never seen; ticks without them stay, with NULL. A point whose value is NULL makes the value unknown.
    """
    into = into or value
    at = F.unix_micros(F.col(time).cast("timestamp"))
    shape = f"struct<at:bigint,v:{points.schema[value].dataType.simpleString()}>"
    rows = ticks.select(F.col(key).alias("_key"), at.alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.col(tick).alias("_id"),
                        F.struct(*ticks.columns).alias("_tick"), F.lit(None).cast(shape).alias("_point"))
    known = points.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("_key"), at.alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.col(point).alias("_id"),
        F.lit(None).cast(ticks.select(F.struct(*ticks.columns).alias("_tick")).schema["_tick"].dataType).alias("_tick"),
        F.struct(at.alias("at"), F.col(value).alias("v")).cast(shape).alias("_point"))
    order = RowOrder(("_key",), ("_at", "_side", "_id"), ranges=ranges, smallest_sample=smallest_sample)
    found = order.fill_forward(rows.unionByName(known), "_point", "_last").where(F.col("_tick").isNotNull())
    age = (F.col("_at") - F.col("_last.at")) / 1e6
    seen = F.lit(True) if within is None else age <= within
    own = [F.col("_tick")[c].alias(c) for c in ticks.columns if c not in (into, "age_seconds")]
    return found.select(*own, F.when(seen, F.col("_last.v")).alias(into), F.when(seen, age).alias("age_seconds"))
