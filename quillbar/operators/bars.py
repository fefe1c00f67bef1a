"""Technical indicators, forward returns and labels on price bars.

``DAILY`` is the row order of a bar table: one row per symbol and day, so a symbol's rows are
bounded by the calendar and one shuffle on the symbol serves all windows. Pass another
``RowOrder`` for tables where a symbol may have any number of rows.
"""

from __future__ import annotations

from dataclasses import replace
from math import isqrt

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from quillbar.functions.numeric import ratio
from quillbar.operators.ordered import RowOrder

DAILY = RowOrder(("symbol",), ("date",), bounded=True)

BLOCK = 5
"""The rows of a block of ``moving``: frames of 5, 7, 14, 20 and 50 rows are a few blocks and at most four more rows."""

INDICATORS = [
    "price_change_1d", "price_change_7d", "volume_20d_avg", "volume_ratio", "volatility_7d",
    "volatility_20d", "rsi_14d", "ma_5d", "ma_20d", "ma_50d", "price_vs_ma5", "price_vs_ma20", "price_vs_ma50",
]


def full_window(aggregate, column: str, spec: WindowSpec, rows: int) -> Column:
    """The aggregate over the last ``rows`` rows; NULL until all of them have a value."""
    frame = spec.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(column).over(frame) >= rows, aggregate(column).over(frame))


def moving(df: DataFrame, spec: WindowSpec, wanted: dict[str, tuple], block: int) -> DataFrame:
    """Add means and sample deviations over the last rows: ``wanted`` maps a name to ``(F.avg or F.stddev_samp, column, rows)``.

    As with ``full_window``, NULL until all the rows have a value. A sliding frame goes through all of its rows for each row. Here
    ``block`` consecutive rows are summed up first, and a frame is put together from such blocks and a few single rows, all found by
    offset. Nothing is taken away from a sum and deviations are taken from means, so no digits cancel and equal values have no deviation.
    """
    exact = {n: w for n, w in wanted.items() if df.schema[w[1]].dataType.typeName() == "decimal"}
    rolled = {n: w for n, w in wanted.items() if n not in exact}
    value = {c: f"_v{i}" for i, c in enumerate(dict.fromkeys(c for _, c, _ in rolled.values()))}
    spread = dict.fromkeys(value[c] for a, c, _ in rolled.values() if a is F.stddev_samp)
    added = dict.fromkeys(value[c] for a, c, _ in rolled.values() if a is F.avg)

    def at(name: str, back: int) -> Column:
        return F.col(f"{name}_{back}" if back else name)

    def offsets(found: dict[str, set[int]]) -> dict[str, Column]:
        return {f"{n}_{k}": F.lag(n, k).over(spec) for n, some in found.items() for k in sorted(some) if k}

    def total(terms: list[Column]) -> Column:
        out = terms[0]
        for term in terms[1:]:
            out = out + term
        return out

    def center(parts: list[tuple[int, Column]], rows: int) -> Column:
        """The mean of ``rows`` rows in parts, each of so many rows with this mean."""
        first = parts[0][1]
        return first + total([n * (mean - first) for n, mean in parts]) / rows

    def apart(parts: list[tuple[int, Column]], mean: Column) -> Column:
        return total([n * (own - mean) * (own - mean) for n, own in parts])

    out = df.withColumns({v: F.col(c).cast("double") for c, v in value.items()})
    out = out.withColumns(offsets({v: set(range(1, block)) for v in value.values()}))
    singles = {v: [(1, at(v, k)) for k in range(block)] for v in value.values()}
    out = out.withColumns({**{f"{v}s": total([x for _, x in reversed(singles[v])]) for v in added},
                           **{f"{v}m": center(singles[v], block) for v in spread}})
    out = out.withColumns({f"{v}q": apart(singles[v], F.col(f"{v}m")) for v in spread})
    out = out.drop(*[f"{v}_{k}" for v in value.values() for k in range(1, block)])

    need: dict[str, set[int]] = {}
    for aggregate, c, rows in rolled.values():
        v, whole = value[c], rows // block
        for name in [f"{v}s"] if aggregate is F.avg else [f"{v}m", f"{v}q"]:
            need.setdefault(name, set()).update(k * block for k in range(whole))
        need.setdefault(v, set()).update(range(whole * block, rows))
    out = out.withColumns(offsets(need))
    means, made = {}, {}
    for name, (aggregate, c, rows) in rolled.items():
        v, starts = value[c], range(0, rows // block * block, block)
        rest = [(1, at(v, k)) for k in range(rows // block * block, rows)]
        if aggregate is F.avg:
            made[name] = total([x for _, x in reversed(rest)] + [at(f"{v}s", k) for k in reversed(starts)]) / rows
            continue
        parts = [(block, at(f"{v}m", k)) for k in starts] + rest
        means[f"_mean_{name}"] = center(parts, rows)
        within = [at(f"{v}q", k) for k in starts]
        made[name] = F.sqrt(total([*within, apart(parts, F.col(f"_mean_{name}"))]) / (rows - 1))
    out = out.withColumns(means).withColumns(made).withColumns({n: full_window(a, c, spec, rows) for n, (a, c, rows) in exact.items()})
    return out.select(*df.columns, *wanted)


def pct_change(price: str, spec: WindowSpec, rows: int = 1) -> Column:
    return ratio(F.col(price), F.lag(price, rows).over(spec)) - 1


def _priced(df: DataFrame, order: RowOrder, price: str, fill: str) -> tuple[DataFrame, str]:
    if fill == "none":
        return df, price
    if fill != "pad":
        raise ValueError("fill must be 'pad' or 'none'")
    return order.fill_forward(df, price, "_price"), "_price"


def order_for(df: DataFrame, order: RowOrder) -> RowOrder:
    """The order to use on this table: only whole days bound a symbol's rows by the calendar, so a
    table keyed by time stamps loses that promise."""
    by_day = all(df.schema[c].dataType.typeName() == "date" for c in order.order)
    return order if by_day or not order.bounded else replace(order, bounded=False)


def returns(df: DataFrame, rows: int = 1, into: str = "price_change_1d", price: str = "close",
            order: RowOrder = DAILY, fill: str = "pad") -> DataFrame:
    """Return over ``rows`` rows. ``fill='pad'`` carries the last known price over gaps."""
    order = order_for(df, order)
    priced, column = _priced(df, order, price, fill)
    return order.frames(priced, rows, 0, lambda d, w: d.withColumn(into, pct_change(column, w, rows))).drop("_price")


def _moves(df: DataFrame, spec: WindowSpec, price: str) -> DataFrame:
    """Add ``_gain`` and ``_loss``, the move from the row before by its sign; no move where a price is missing."""
    delta = F.coalesce(F.col(price) - F.lag(price, 1).over(spec), F.lit(0.0))
    return df.withColumn("_delta", delta).withColumns(
        {"_gain": F.greatest("_delta", F.lit(0.0)), "_loss": F.greatest(-F.col("_delta"), F.lit(0.0))}).drop("_delta")


def _strength(gain: Column, loss: Column) -> Column:
    return F.when(loss == 0, F.when(gain > 0, 100.0)).otherwise(100 - 100 / (1 + ratio(gain, loss)))


def _with_rsi(df: DataFrame, spec: WindowSpec, price: str, rows: int, into: str) -> DataFrame:
    means = {"_mean_gain": (F.avg, "_gain", rows), "_mean_loss": (F.avg, "_loss", rows)}
    moved = moving(_moves(df, spec, price), spec, means, max(isqrt(rows), 1))
    return moved.withColumn(into, _strength(F.col("_mean_gain"), F.col("_mean_loss"))).drop("_gain", "_loss", *means)


def rsi(df: DataFrame, rows: int = 14, into: str = "rsi_14d", price: str = "close", scope: str = "symbol",
        order: RowOrder = DAILY) -> DataFrame:
    """Relative strength index from simple rolling means.

    ``scope='symbol'`` restarts at each symbol. ``scope='frame'`` runs through the table in
    (symbol, date) order, so a symbol's first rows see the end of the symbol before it.
    """
    order = order_for(df, order)
    if scope == "frame":
        order = replace(order, keys=(), order=order.keys + order.order, bounded=False)
    return order.frames(df, rows, 0, lambda d, w: _with_rsi(d, w, price, rows, into))


def add_indicators(df: DataFrame, order: RowOrder = DAILY, fill: str = "pad", rsi_scope: str = "symbol") -> DataFrame:
    """All 13 indicators. ``rsi_scope`` is the scope of ``rsi``; all others restart at each symbol."""
    if rsi_scope not in ("symbol", "frame"):
        raise ValueError("rsi_scope must be 'symbol' or 'frame'")
    order = order_for(df, order)
    priced, price = _priced(df, order, "close", fill)

    wanted = {
        "volume_20d_avg": (F.avg, "volume", 20), "ma_5d": (F.avg, "close", 5), "ma_20d": (F.avg, "close", 20), "ma_50d": (F.avg, "close", 50),
        "volatility_7d": (F.stddev_samp, "price_change_1d", 7), "volatility_20d": (F.stddev_samp, "price_change_1d", 20),
    }
    if rsi_scope == "symbol":
        wanted |= {"_mean_gain": (F.avg, "_gain", 14), "_mean_loss": (F.avg, "_loss", 14)}

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        close = F.col("close")
        d = d.withColumns({"price_change_1d": pct_change(price, w, 1), "price_change_7d": pct_change(price, w, 7)})
        if rsi_scope == "symbol":
            d = _moves(d, w, "close")
        d = moving(d, w, wanted, BLOCK)
        if rsi_scope == "symbol":
            d = d.withColumn("rsi_14d", _strength(F.col("_mean_gain"), F.col("_mean_loss")))
        return d.withColumns({
            "volume_ratio": ratio(F.col("volume"), F.col("volume_20d_avg")),
            "price_vs_ma5": ratio(close, F.col("ma_5d")) - 1,
            "price_vs_ma20": ratio(close, F.col("ma_20d")) - 1,
            "price_vs_ma50": ratio(close, F.col("ma_50d")) - 1,
        })

    out = order.frames(priced, 50, 0, add)
    if rsi_scope == "frame":
        out = rsi(out, scope="frame", order=order)
    return out.select(*df.columns, *INDICATORS)


def rolling(df: DataFrame, aggregate, column: str, rows: int, into: str, order: RowOrder = DAILY) -> DataFrame:
    """One rolling aggregate with a full window."""
    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        if aggregate in (F.avg, F.stddev_samp) and rows > BLOCK:
            return moving(d, w, {into: (aggregate, column, rows)}, isqrt(rows))
        return d.withColumn(into, full_window(aggregate, column, w, rows))

    return order_for(df, order).frames(df, rows, 0, add)


def future_return(df: DataFrame, horizon: int = 1, price: str = "close", order: RowOrder = DAILY) -> DataFrame:
    """Return from this row to the one ``horizon`` rows later."""
    order = order_for(df, order)
    if horizon == 1:
        ahead = order.following(df, price, "_ahead")
    else:
        ahead = order.frames(df, 0, horizon, lambda d, w: d.withColumn("_ahead", F.lead(price, horizon).over(w)))
    return ahead.withColumn("future_return", ratio(F.col("_ahead"), F.col(price)) - 1).drop("_ahead")


def label_of(value: Column, threshold: float) -> Column:
    """Strictly above: positive; strictly below the negative: negative; NULL stays NULL."""
    return (
        F.when(value.isNull(), None).when(value > threshold, "positive")
        .when(value < -threshold, "negative").otherwise("neutral")
    )


def create_labels(df: DataFrame, order: RowOrder = DAILY, horizon: int = 1, threshold: float = 0.02) -> DataFrame:
    """Add ``future_return`` and ``sentiment_label``; a label already there moves to ``source_label``."""
    if "sentiment_label" in df.columns:
        df = df.withColumnRenamed("sentiment_label", "source_label")
    out = future_return(df, horizon, "close", order)
    return out.withColumn("sentiment_label", label_of(F.col("future_return"), threshold))


label_bars = create_labels


def label_rows(df: DataFrame, order_by: tuple[str, ...], horizon: int = 1, threshold: float = 0.02,
               **layout) -> DataFrame:
    """Labels on a table with any number of rows per symbol and day, in the order given.

    The row ``horizon`` places on may be of the same day; its return is then 0 and it is neutral.
    """
    return create_labels(df, RowOrder(("symbol",), tuple(order_by), **layout), horizon, threshold)
