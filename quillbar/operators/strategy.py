"""Trading-strategy returns and metrics from predicted labels.

The input is a table of evaluated rows: ``by`` columns (say, the model), symbol, date, price, the
predicted label, and an order that is unique within each ``by`` group. Symbols may have any number
of rows per day. For bars (one row per symbol and day) pass ``daily=True``: plain windows then do.

Scopes of compounding and drawdown:
``frame``   all rows of a ``by`` group as one account, in the order given;
``symbol``  one account per symbol;
``date``    the mean return of each date, compounded over dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillbar.functions import fixed_values as fixed
from quillbar.functions.numeric import power, ratio
from quillbar.operators.ordered import RowOrder
from quillbar.session import materialize

STRATEGY_METRICS = [
    "total_return", "annualized_return", "volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown",
    "calmar_ratio", "hit_rate", "num_trades", "avg_trade_return", "win_rate",
]


def signal_of(label: Column) -> Column:
    """1, -1 or 0 for a positive, negative or neutral label; NULL for any other."""
    out = F.lit(None).cast("int")
    for name, value in fixed.SIGNALS.items():
        out = F.when(label == name, F.lit(value)).otherwise(out)
    return out


def add_signals(df: DataFrame, label: str = "y_pred") -> DataFrame:
    return df.withColumn("signal", signal_of(F.col(label)))


def strategy_rows(df: DataFrame, by: Sequence[str] = ("model",), order_by: Sequence[str] = ("date", "row_id"),
                  price: str = "close", symbol: str = "symbol", label: str = "y_pred", signal_scope: str = "symbol",
                  fill: str = "pad", daily: bool = False, keep_empty: bool = False, **layout) -> DataFrame:
    """Add ``signal``, ``returns`` (per symbol) and ``strategy_returns`` (last row's signal times
    this row's return); rows without the latter are dropped.

    ``signal_scope='frame'`` takes the last row of the whole ``by`` group, in the order given,
    whichever its symbol.
    """
    signalled = add_signals(df, label)
    per_symbol = RowOrder((*by, symbol), tuple(order_by), bounded=daily, **layout)
    last = {"signal": "_signal"} if signal_scope == "symbol" else {}
    if fill == "pad":
        out = per_symbol.previous(signalled, last, {price: "_price"})
    else:
        out = per_symbol.previous(signalled, {**last, price: "_price"})
    now = F.coalesce(F.col(price), F.col("_price")) if fill == "pad" else F.col(price)
    out = out.withColumn("returns", ratio(now, F.col("_price")) - 1).drop("_price")
    if signal_scope == "frame":
        whole = RowOrder(tuple(by), tuple(order_by), **layout)
        out = whole.previous(materialize(out), {"signal": "_signal"})
    elif signal_scope != "symbol":
        raise ValueError("signal_scope must be 'symbol' or 'frame'")
    out = out.withColumn("strategy_returns", F.col("_signal") * F.col("returns")).drop("_signal")
    return out if keep_empty else out.where(F.col("strategy_returns").isNotNull())


def strategy_curve(rows: DataFrame, by: Sequence[str] = ("model",), order_by: Sequence[str] = ("date", "row_id"),
                   scope: str = "frame", symbol: str = "symbol", daily: bool = False,
                   include_start: bool = False, **layout) -> DataFrame:
    """Add ``equity``, ``peak`` and ``drawdown`` to ``strategy_rows`` (scopes frame and symbol)."""
    if scope == "symbol":
        order = RowOrder((*by, symbol), tuple(order_by), bounded=daily, **layout)
    elif scope == "frame":
        order = RowOrder(tuple(by), tuple(order_by), **layout)
    else:
        raise ValueError("scope must be 'frame' or 'symbol'")
    return order.compound(rows, "strategy_returns", include_start)


def by_date(rows: DataFrame, by: Sequence[str] = ("model",), date: str = "date") -> DataFrame:
    """The mean strategy return of each date, with the trade counts the metrics need."""
    trade = F.col("signal").isNull() | (F.col("signal") != 0)
    r = F.col("strategy_returns")
    return rows.groupBy(*by, date).agg(
        F.avg(r).alias("strategy_returns"),
        F.count_if(trade).alias("_trades"),
        F.sum(F.when(trade, r)).alias("_trade_sum"),
        F.count_if(trade & (r > 0)).alias("_wins"),
    )


def _summary(curve: DataFrame, by: Sequence[str], date: str, risk_free: float) -> DataFrame:
    r = F.col("strategy_returns")
    if "_trades" not in curve.columns:
        trade = F.col("signal").isNull() | (F.col("signal") != 0)
        curve = curve.withColumns({
            "_trades": trade.cast("int"), "_trade_sum": F.when(trade, r), "_wins": (trade & (r > 0)).cast("int")})
    yearly = fixed.TRADING_DAYS ** 0.5
    base = curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.product(1 + r) - 1).alias("total_return"),
        F.datediff(F.max(date), F.min(date)).alias("_days"),
        (F.stddev_samp(r) * yearly).alias("volatility"),
        (F.stddev_samp(F.when(r < 0, r)) * yearly).alias("_downside"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.sum("_trades").alias("_trades"),
        F.sum("_trade_sum").alias("_trade_sum"),
        F.sum("_wins").alias("_wins"),
    )
    years = F.col("_days") / F.lit(fixed.DAYS_PER_YEAR)
    yearly_return = F.when(F.col("_days") > 0, power(1 + F.col("total_return"), ratio(F.lit(1.0), years)))
    out = base.withColumn("annualized_return", yearly_return - 1)
    excess = F.col("annualized_return") - risk_free
    trades = F.when(F.col("_trades") > 0, F.col("_trades"))
    return out.withColumns({
        "sharpe_ratio": F.when(F.col("volatility") > 0, excess / F.col("volatility")),
        "sortino_ratio": F.when(F.col("_downside") > 0, excess / F.col("_downside")),
        "calmar_ratio": ratio(F.col("annualized_return"), F.abs("max_drawdown")),
        "num_trades": trades,
        "avg_trade_return": ratio(F.col("_trade_sum"), trades),
        "win_rate": ratio(F.col("_wins"), trades),
        "sharpe_simple": F.when(F.col("volatility") > 0,
                                (F.col("total_return") * fixed.TRADING_DAYS - risk_free) / F.col("volatility"))
        .otherwise(0.0),
    }).select(*by, "n_rows", *STRATEGY_METRICS, "sharpe_simple")


def strategy_metrics(df: DataFrame, by: Sequence[str] = ("model",), order_by: Sequence[str] = ("date", "row_id"),
                     price: str = "close", date: str = "date", symbol: str = "symbol", label: str = "y_pred",
                     scope: str = "frame", signal_scope: str = "symbol", fill: str = "pad", daily: bool = False,
                     include_start: bool = False, risk_free: float = fixed.RISK_FREE_RATE, **layout) -> DataFrame:
    """One row of metrics per ``by`` group (and symbol, in symbol scope). A metric that is not
    defined is NULL; a group without any strategy return has no row."""
    needed = [*dict.fromkeys([*by, *order_by, date, symbol, price, label])]
    narrow = df.select(*needed)
    layout.setdefault("sample", narrow)
    rows = strategy_rows(narrow, by, order_by, price, symbol, label, signal_scope, fill, daily, **layout)
    rows = rows.drop(price, label, "returns")
    if scope == "date":
        account = RowOrder(tuple(by), (date,), bounded=True)
        return _summary(account.compound(by_date(rows, by, date), "strategy_returns", include_start), by, date, risk_free)
    group = (*by, symbol) if scope == "symbol" else tuple(by)
    order = RowOrder(group, tuple(order_by), bounded=daily and scope == "symbol", **layout).settle(narrow)
    curve = order.compound(rows if order.bounded else materialize(rows), "strategy_returns", include_start)
    return _summary(curve, group, date, risk_free)


def predictions_by_day(df: DataFrame, by: Sequence[str] = ("model",), label: str = "y_pred", symbol: str = "symbol",
                       date: str = "date") -> DataFrame:
    """One prediction per symbol and day: the sign of the summed signals. For strategies whose
    returns come from the bar calendar instead of from the evaluated rows."""
    total = F.sum(signal_of(F.col(label)))
    return df.groupBy(*by, symbol, date).agg(
        F.when(total > 0, "positive").when(total < 0, "negative").when(total == 0, "neutral").alias(label))
