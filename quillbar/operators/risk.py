"""Benchmark-relative measures, weights, costs and limits on daily strategies.

Input is one row per (``by``, symbol, date). Windows run within a symbol or over the dates of one
``by`` group, both bounded by the calendar. Costs, stops and limits also take tables of any length
(ticks, say): their ``order`` then states the order of the rows, and the work is done by ranges of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillbar.functions.fixed_values import TRADING_DAYS
from quillbar.functions.numeric import ratio
from quillbar.operators.ordered import RowOrder, before, upto
from quillbar.session import materialize


def daily_returns(rows: DataFrame, by: Sequence[str] = ("model",), date: str = "date") -> DataFrame:
    """``by, date, strategy, benchmark``: mean strategy return and mean return of the symbols."""
    return rows.groupBy(*by, date).agg(
        F.avg("strategy_returns").alias("strategy"), F.avg("returns").alias("benchmark"))


def information_ratio(rows: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean over deviation of the daily return above an equal-weight benchmark, per year."""
    active = F.col("strategy") - F.col("benchmark")
    return daily_returns(rows, by).groupBy(*by).agg(
        (ratio(F.avg(active), F.stddev_samp(active)) * TRADING_DAYS ** 0.5).alias("information_ratio"))


def alpha_beta(rows: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Intercept and slope of daily strategy returns on benchmark returns."""
    return daily_returns(rows, by).groupBy(*by).agg(
        F.regr_intercept("strategy", "benchmark").alias("alpha"), F.regr_slope("strategy", "benchmark").alias("beta"))


def position_weights(df: DataFrame, by: Sequence[str] = ("model",), cap: float = 0.1, date: str = "date") -> DataFrame:
    """Add ``weight``: the signal times an equal share among the day's active symbols, at most
    ``cap``. The day counts are a small table joined back, so no task holds a day's symbols."""
    active = df.where(F.col("signal") != 0).groupBy(*by, date).agg(F.count(F.lit(1)).alias("_active"))
    share = F.least(ratio(F.lit(1.0), F.col("_active")), F.lit(cap))
    return df.join(active, [*by, date], "left").withColumn(
        "weight", F.coalesce(F.col("signal") * share, F.lit(0.0))).drop("_active")


def rebalance(df: DataFrame, period: str, by: Sequence[str] = ("model",), symbol: str = "symbol",
              date: str = "date") -> DataFrame:
    """Hold each period's first weight until the next period (``day``, ``week`` or ``month``)."""
    start = F.to_date(F.date_trunc(period, F.col(date)))
    spec = upto(Window.partitionBy(*by, symbol, "_period").orderBy(date))
    return df.withColumn("_period", start).withColumn("weight", F.first("weight").over(spec)).drop("_period")


def backtest_costs(df: DataFrame, by: Sequence[str] = ("model",), symbol: str = "symbol", date: str = "date",
                   capital: float = 100_000.0, cost: float = 0.001, slippage: float = 0.0005,
                   order: RowOrder | None = None) -> DataFrame:
    """``by, date, gross, cost, capital``: the account after trading costs.

    A row earns the weight held since the symbol's row before; a change of weight costs
    ``cost + slippage`` of its size. With ``order`` (keys ``by`` and symbol) rows and dates may be any number.
    """
    rows = order or RowOrder((*by, symbol), (date,), bounded=True)
    held = F.coalesce(F.col("_last"), F.lit(0.0))
    per_row = rows.previous(df, {"weight": "_last"}).withColumn("_held", held).withColumns({
        "_gross": F.coalesce(F.col("_held") * F.col("returns"), F.lit(0.0)),
        "_cost": F.abs(F.col("weight") - F.col("_held")) * (cost + slippage),
    })
    per_day = per_row.groupBy(*by, date).agg(F.sum("_gross").alias("gross"), F.sum("_cost").alias("cost"))
    dates = RowOrder(tuple(by), (date,), bounded=rows.bounded, smallest_sample=rows.smallest_sample, ranges=rows.ranges)
    if not rows.bounded:
        per_day = materialize(per_day)
    account = dates.compound(per_day.withColumn("_net", F.col("gross") - F.col("cost")), "_net")
    return account.withColumn("capital", capital * F.col("equity")).drop("_net", "equity", "peak", "drawdown")


def _outside(growth: Column, stop_loss: float, take_profit: float) -> Column:
    return (growth - 1 <= -stop_loss) | (growth - 1 >= take_profit)


def stops(df: DataFrame, by: Sequence[str] = ("model",), symbol: str = "symbol", date: str = "date",
          stop_loss: float = 0.05, take_profit: float = 0.15, order: RowOrder | None = None) -> DataFrame:
    """Add ``stopped_returns``: a position closes after its gain or loss since entry first reaches
    a limit, and stays closed until the signal changes.

    With ``order`` (keys ``by`` and symbol) a symbol may have any number of rows. Each range of the order is then
    summed up by how it changes the state of a position (growth since entry, closed or not): a range without a new
    position multiplies the growth and closes it if its highest or lowest point, times the growth before, is outside; any
    other range leaves the state of its last position. The states are combined over the ranges, two rows for each.
    """
    rows = (order or RowOrder((*by, symbol), (date,), bounded=True)).settle(df)
    out = rows.previous(df, {"signal": "_last"}).withColumn("_held", F.coalesce(F.col("_last"), F.lit(0)))
    # a new position starts in the row after a signal that differs from the position held
    out = out.withColumns({"_r": F.coalesce(F.col("_held") * F.col("returns"), F.lit(0.0)),
                           "_turn": (F.coalesce(F.col("signal"), F.lit(0)) != F.col("_held")).cast("int")})
    if rows.bounded:
        ranged, here = out.withColumn("_range", F.lit(0)), rows.window()
    else:
        ranged = rows._placed(rows._ranged(materialize(out)))
        here = rows._here()
    keys, growth = ("_range", *rows.keys, "_trade"), F.product(1 + F.col("_r"))
    trade = Window.partitionBy(*keys).orderBy(*rows.order)

    def grown(table: DataFrame) -> DataFrame:
        numbered = table.withColumn("_trade", F.coalesce(F.sum("_turn").over(before(here)), F.lit(0)))
        return numbered.withColumn("_growth", growth.over(upto(trade)))

    walked = grown(ranged)
    if rows.bounded:
        walked = walked.withColumns({"_start": F.lit(1.0), "_closed": F.lit(False)})
    else:
        walked = rows._join(walked, _states(rows, grown(rows._continued(ranged)), stop_loss, take_profit))
        goes_on = F.col("_trade") == 0
        walked = walked.withColumns({
            "_start": F.when(goes_on, F.coalesce("_start", F.lit(1.0))).otherwise(1.0),
            "_closed": goes_on & F.coalesce("_closed", F.lit(False))})
    breach = _outside(F.col("_start") * F.col("_growth"), stop_loss, take_profit).cast("int")
    done = F.col("_closed") | (F.coalesce(F.max("_breach").over(before(trade)), F.lit(0)) == 1)
    return walked.withColumn("_breach", breach).withColumn("_done", done).withColumn(
        "stopped_returns", F.when(F.col("_done"), 0.0).otherwise(F.col("_r"))).drop(
        "_last", "_held", "_turn", "_trade", "_r", "_growth", "_start", "_closed", "_breach", "_done", "_range")


def _states(order: RowOrder, walked: DataFrame, stop_loss: float, take_profit: float) -> DataFrame:
    """``keys, _range, _start, _closed``: the state of the position with which a range starts."""
    group = (*order.keys, "_range")
    parts = walked.groupBy(*group, "_trade").agg(
        F.product(1 + F.col("_r")).alias("_all"), F.min("_growth").alias("_low"), F.max("_growth").alias("_high"),
        F.sum("_turn").alias("_turns"))
    # the last position of a range; after a turn in its last row, one without rows yet
    last = F.max_by(F.struct("_all", "_low", "_high", "_turns"), F.col("_trade"))
    table = parts.groupBy(*group).agg(F.sum("_turns").alias("_turns"), last.alias("_last_part"))
    fresh = F.col("_last_part._turns") > 0
    lows, highs = (F.when(fresh, 1.0).otherwise(F.col(f"_last_part.{c}")) for c in ("_low", "_high"))
    by_range = order._ranges_of_key()
    run = Window.partitionBy(*order.keys, "_run").orderBy("_range")
    table = table.withColumns({
        "_factor": F.when(fresh, 1.0).otherwise(F.col("_last_part._all")), "_lows": lows, "_highs": highs,
        "_run": F.sum((F.col("_turns") > 0).cast("int")).over(upto(by_range))})
    table = table.withColumn("_end", F.product("_factor").over(upto(run)))
    table = table.withColumn("_start", F.lag("_end", 1, 1.0).over(by_range))
    given = F.when(F.col("_turns") > 0, 1.0).otherwise(F.col("_start"))
    breach = _outside(given * F.col("_lows"), stop_loss, take_profit) | _outside(given * F.col("_highs"), stop_loss, take_profit)
    table = table.withColumn("_breach", breach.cast("int")).withColumn("_shut", F.max("_breach").over(upto(run)) == 1)
    return table.withColumn("_closed", F.lag("_shut", 1, False).over(by_range)).select(*group, "_start", "_closed")


def drawdown_limit(daily: DataFrame, by: Sequence[str] = ("model",), date: str = "date", returns: str = "strategy",
                   limit: float = 0.2, order: RowOrder | None = None) -> DataFrame:
    """Add ``limited_returns``: zero after the first row whose drawdown reaches ``limit``. With ``order`` (keys
    ``by``) an account may have any number of rows."""
    rows = (order or RowOrder(tuple(by), (date,), bounded=True)).settle(daily)
    curve = rows.compound(daily, returns)
    if not rows.bounded:
        curve = materialize(curve)
    out = rows.previous(curve.withColumn("_breach", F.when(F.col("drawdown") <= -limit, True)), {}, {"_breach": "_done"})
    return out.withColumn("limited_returns", F.when(F.col("_done"), 0.0).otherwise(F.col(returns))).drop("_breach", "_done")
