import datetime as dt
import math
import random
import statistics

import pytest

from quillbar.operators import risk, strategy
from quillbar.operators.ordered import RowOrder

DAY = dt.date(2020, 1, 1)
SCHEMA = "model string, row_id long, date date, symbol string, close double, y_pred string"
CUT = {"ranges": 6, "smallest_sample": 60}


def rows(spark, items):
    data = [("m", i, DAY + dt.timedelta(days=d), s, p, y) for i, (d, s, p, y) in enumerate(items)]
    return spark.createDataFrame(data, SCHEMA)


def random_items(n=260, seed=4, symbols="AAAB"):
    rng = random.Random(seed)
    return [(i // 3, rng.choice(symbols), round(rng.uniform(95, 105), 2) if rng.random() > 0.1 else None,
             rng.choice(["positive", "negative", "neutral", None])) for i in range(n)]


def brute(items, frame_signal=False):
    """(row, signal, return, strategy return) row by row."""
    sign = {"positive": 1, "negative": -1, "neutral": 0}
    price, signal, last, out = {}, {}, None, []
    for i, (d, s, p, y) in enumerate(items):
        now = p if p is not None else price.get(s)
        r = now / price[s] - 1 if price.get(s) is not None and now is not None else None
        held = last if frame_signal else signal.get(s)
        mine = sign.get(y)
        out.append((i, mine, r, held * r if held is not None and r is not None else None))
        if now is not None:
            price[s] = now
        signal[s] = last = mine
    return [x for x in out if x[3] is not None]


@pytest.mark.parametrize("layout", [{}, CUT])
@pytest.mark.parametrize("frame", [False, True])
def test_rows_against_brute_force(spark, layout, frame):
    items = random_items()
    got = strategy.strategy_rows(rows(spark, items), signal_scope="frame" if frame else "symbol", **layout)
    got = [(r["row_id"], r["signal"], r["returns"], r["strategy_returns"]) for r in got.orderBy("row_id").collect()]
    assert got == brute(items, frame)


def metrics_of(kept, items):
    r = [x[3] for x in kept]
    total = math.prod(1 + x for x in r) - 1
    days = items[kept[-1][0]][0] - items[kept[0][0]][0]
    yearly = (1 + total) ** (365.25 / days) - 1
    vol = statistics.stdev(r) * math.sqrt(252)
    down = statistics.stdev([x for x in r if x < 0]) * math.sqrt(252)
    cum, peak, worst = 1.0, None, 0.0
    for x in r:
        cum *= 1 + x
        peak = cum if peak is None else max(peak, cum)
        worst = min(worst, (cum - peak) / peak)
    trades = [x[3] for x in kept if x[1] is None or x[1] != 0]
    return {"total_return": total, "annualized_return": yearly, "volatility": vol, "sharpe_ratio": (yearly - .02) / vol,
            "sortino_ratio": (yearly - .02) / down, "max_drawdown": worst, "calmar_ratio": yearly / abs(worst),
            "hit_rate": sum(x > 0 for x in r) / len(r), "num_trades": len(trades),
            "avg_trade_return": sum(trades) / len(trades), "win_rate": sum(x > 0 for x in trades) / len(trades),
            "sharpe_simple": (total * 252 - .02) / vol}


@pytest.mark.parametrize("layout", [{}, CUT])
def test_metrics_against_brute_force(spark, layout):
    items = random_items()
    got = strategy.strategy_metrics(rows(spark, items), **layout).first().asDict()
    for name, value in metrics_of(brute(items), items).items():
        assert got[name] == pytest.approx(value, rel=1e-9), name


def test_symbol_scope_is_one_account_each(spark):
    items = random_items()
    got = {r["symbol"]: r for r in strategy.strategy_metrics(rows(spark, items), scope="symbol", **CUT).collect()}
    for s in "AB":
        kept = [x for x in brute(items) if items[x[0]][1] == s]
        assert got[s]["max_drawdown"] == pytest.approx(metrics_of(kept, items)["max_drawdown"])


def test_date_scope_compounds_daily_means(spark):
    items = random_items()
    by_day = {}
    for i, _, _, r in brute(items):
        by_day.setdefault(items[i][0], []).append(r)
    got = strategy.strategy_metrics(rows(spark, items), scope="date").first()
    assert got["n_rows"] == len(by_day)
    assert got["total_return"] == pytest.approx(math.prod(1 + sum(v) / len(v) for v in by_day.values()) - 1)
    assert got["num_trades"] == sum(x[1] is None or x[1] != 0 for x in brute(items))


def test_undefined_metrics_are_null(spark):
    one_day = strategy.strategy_metrics(rows(spark, [(0, "A", 100.0, "positive"), (0, "A", 101.0, "neutral")])).first()
    assert one_day["annualized_return"] is None and one_day["sharpe_ratio"] is None and one_day["volatility"] is None
    assert one_day["num_trades"] is None and one_day["win_rate"] is None and one_day["sharpe_simple"] == 0.0
    hold = strategy.strategy_metrics(rows(spark, [(i, "A", 100.0 + i, "neutral") for i in range(5)])).first()
    assert hold["total_return"] == 0.0 and hold["calmar_ratio"] is None and hold["sortino_ratio"] is None
    assert strategy.strategy_metrics(rows(spark, [(0, "A", 100.0, "positive")])).count() == 0


def test_trades_use_the_current_signal(spark):
    got = strategy.strategy_metrics(rows(spark, [(0, "A", 100.0, "positive"), (1, "A", 110.0, "neutral"), (2, "A", 121.0, None)])).first()
    assert got["num_trades"] == 1 and got["avg_trade_return"] == 0.0 and got["hit_rate"] == 0.5


def test_peak_starts_at_the_first_value(spark):
    items = [(0, "A", 100.0, "positive"), (1, "A", 90.0, "positive"), (2, "A", 99.0, "positive")]
    assert strategy.strategy_metrics(rows(spark, items)).first()["max_drawdown"] == 0.0
    assert strategy.strategy_metrics(rows(spark, items), include_start=True).first()["max_drawdown"] == pytest.approx(-0.1)


def test_total_loss_has_no_yearly_return(spark):
    got = strategy.strategy_metrics(rows(spark, [(0, "A", 100.0, "negative"), (400, "A", 250.0, "negative"), (500, "A", 260.0, None)])).first()
    assert got["total_return"] < -1 and got["annualized_return"] is None and got["sharpe_ratio"] is None


def test_hundred_random_days(spark):
    rng = random.Random(9)
    price, items = 100.0, []
    for i in range(100):
        price += rng.gauss(0, 0.01)
        items.append((i, "AAPL", price, rng.choice(["positive", "negative", "neutral"])))
    got = strategy.strategy_metrics(rows(spark, items)).first()
    assert got["total_return"] is not None and got["volatility"] > 0


def test_predictions_by_day(spark):
    df = rows(spark, [(0, "A", 1.0, "positive"), (0, "A", 1.0, "positive"), (0, "A", 1.0, "negative"), (1, "A", 1.0, "positive"), (1, "A", 1.0, "negative")])
    assert [r["y_pred"] for r in strategy.predictions_by_day(df).orderBy("date").collect()] == ["positive", "neutral"]


def bar_rows(spark, closes, preds, symbol="A"):
    return strategy.strategy_rows(rows(spark, [(i, symbol, c, p) for i, (c, p) in enumerate(zip(closes, preds))]),
                                  order_by=("date",), daily=True, keep_empty=True)


def test_stops(spark):
    closes = [100, 96, 94, 90, 95, 100]
    out = risk.stops(bar_rows(spark, [float(c) for c in closes], ["positive"] * 3 + ["negative"] * 3))
    got = [r["stopped_returns"] for r in out.orderBy("date").collect()]
    assert got[:4] == pytest.approx([0.0, -0.04, 94 / 96 - 1, 0.0])
    assert got[4:] == pytest.approx([1 - 95 / 90, 0.0])


def test_weights_rebalance_costs(spark):
    df = bar_rows(spark, [100.0, 110.0, 121.0], ["positive", "positive", "neutral"])
    weighted = risk.position_weights(df, cap=0.5)
    assert [r["weight"] for r in weighted.orderBy("date").collect()] == [0.5, 0.5, 0.0]
    held = risk.rebalance(weighted, "month")
    assert [r["weight"] for r in held.orderBy("date").collect()] == [0.5, 0.5, 0.5]
    account = risk.backtest_costs(weighted, capital=1000.0).orderBy("date").collect()
    assert [r["capital"] for r in account] == pytest.approx(
        [1000 * (1 - 0.00075), 1000 * (1 - 0.00075) * 1.05, 1000 * (1 - 0.00075) * 1.05 * (1.05 - 0.00075)])


def test_drawdown_limit(spark):
    df = spark.createDataFrame([("m", DAY + dt.timedelta(days=i), r) for i, r in enumerate([0.1, -0.15, -0.1, 0.2, 0.1])], "model string, date date, strategy double")
    out = risk.drawdown_limit(df)
    assert [r["limited_returns"] for r in out.orderBy("date").collect()] == [0.1, -0.15, -0.1, 0.0, 0.0]


def test_information_ratio_alpha_beta(spark):
    df = spark.createDataFrame([("m", DAY + dt.timedelta(days=i), 2 * b + 0.01, b) for i, b in enumerate([0.01, -0.02, 0.03])],
                               "model string, date date, strategy_returns double, returns double")
    got = risk.alpha_beta(df).first()
    assert (got["alpha"], got["beta"]) == (pytest.approx(0.01), pytest.approx(2))
    a = [b + 0.01 for b in (0.01, -0.02, 0.03)]
    assert risk.information_ratio(df).first()[1] == pytest.approx(statistics.mean(a) / statistics.stdev(a) * math.sqrt(252))


def walked(returns, signals, low, high):
    """Stopped returns of one symbol, row by row."""
    out, held, growth, closed = [], 0, 1.0, False
    for r, signal in zip(returns, signals):
        own = held * (r or 0.0)
        out.append(0.0 if closed else own)
        growth *= 1 + own
        closed = closed or growth - 1 <= -low or growth - 1 >= high
        if signal != held:
            held, growth, closed = signal, 1.0, False
    return out


@pytest.mark.parametrize("hold", [3, 40, 400, 5000])
def test_stops_by_ranges(spark, hold):
    rng = random.Random(hold)
    items, want = [], {}
    for symbol, n in (("A", 900), ("B", 300), ("C", 1)):
        returns = [None] + [rng.gauss(0, 0.02) for _ in range(n - 1)]
        signals = [(i // hold + 1) % 3 - 1 for i in range(n)]
        if hold == 400:
            returns[50:53] = [1.5] * min(3, n)
            returns, signals = returns[:n], [-1] * n
        items += [("m", symbol, i, r, s) for i, (r, s) in enumerate(zip(returns, signals))]
        want |= {(symbol, i): v for i, v in enumerate(walked(returns, signals, 0.05, 0.15))}
    rng.shuffle(items)
    df = spark.createDataFrame(items, "model string, symbol string, n long, returns double, signal int")
    for order in (None, RowOrder(("model", "symbol"), ("n",), ranges=37, smallest_sample=50)):
        out = risk.stops(df, date="n", order=order).collect()
        assert {(r["symbol"], r["n"]): r["stopped_returns"] for r in out} == pytest.approx(want)
        assert len(out) == len(items)


def test_limit_and_costs_by_ranges(spark):
    rng = random.Random(5)
    items = [("m", s, i, rng.gauss(0, 0.01), rng.random()) for s in "AB" for i in range(500)]
    df = spark.createDataFrame(items, "model string, symbol string, n long, returns double, weight double")
    small = RowOrder(("model", "symbol"), ("n",), ranges=29, smallest_sample=50)
    plain = risk.backtest_costs(df, date="n").orderBy("n").collect()
    ranged = risk.backtest_costs(df, date="n", order=small).orderBy("n").collect()
    assert [r["capital"] for r in ranged] == pytest.approx([r["capital"] for r in plain]) and len(plain) == 500
    account = df.withColumn("model", df["symbol"])
    plain, ranged = (risk.drawdown_limit(account, date="n", returns="returns", limit=0.1, order=o).orderBy("symbol", "n").collect()
                     for o in (None, RowOrder(("model",), ("n",), ranges=29, smallest_sample=50)))
    assert [r["limited_returns"] for r in ranged] == [r["limited_returns"] for r in plain]
    assert 0 < sum(r["limited_returns"] == 0 for r in plain) < 1000
