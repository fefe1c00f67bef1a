import datetime as dt
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from quillbar.operators import bars
from quillbar.operators.ordered import RowOrder

SCHEMA = "symbol string, date date, close double, volume long"


def series(spark, prices, symbol="A", volumes=None):
    start = dt.date(2020, 1, 1)
    rows = [(symbol, start + dt.timedelta(days=2 * i), p, (volumes or [10] * len(prices))[i]) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "date").collect()]


def test_return_carries_last_price_over_a_gap(spark):
    df = series(spark, [1.0, None, 2.0])
    assert column(bars.returns(df), "price_change_1d") == [None, 0.0, 1.0]
    assert column(bars.returns(df, fill="none"), "price_change_1d") == [None, None, None]


def test_zero_price_gives_null(spark):
    assert column(bars.returns(series(spark, [0.0, 5.0, 5.0])), "price_change_1d") == [None, None, 0.0]
    assert column(bars.future_return(series(spark, [0.0, 5.0])), "future_return") == [None, None]


def test_zero_volume_average_gives_null(spark):
    out = column(bars.add_indicators(series(spark, [1.0] * 20, volumes=[0] * 20)), "volume_ratio")
    assert out == [None] * 20


def test_windows_are_full_and_count_rows(spark):
    rng = random.Random(1)
    prices = [round(rng.uniform(90, 110), 2) for _ in range(60)]
    out = bars.add_indicators(series(spark, prices))
    rets = [b / a - 1 for a, b in zip(prices, prices[1:])]
    vol7, ma50 = column(out, "volatility_7d"), column(out, "ma_50d")
    assert vol7[:7] == [None] * 7 and vol7[7] == pytest.approx(statistics.stdev(rets[:7]))
    assert ma50[:49] == [None] * 49 and ma50[59] == pytest.approx(sum(prices[10:]) / 50)
    assert column(out, "price_change_7d")[7] == pytest.approx(prices[7] / prices[0] - 1)
    assert column(out, "price_vs_ma5")[4] == pytest.approx(prices[4] / (sum(prices[:5]) / 5) - 1)


def test_rsi_edges(spark):
    rising = column(bars.rsi(series(spark, [float(i) for i in range(1, 20)])), "rsi_14d")
    assert rising[:13] == [None] * 13 and rising[13:] == [100.0] * 6
    assert column(bars.rsi(series(spark, [5.0] * 20)), "rsi_14d") == [None] * 20
    falling = column(bars.rsi(series(spark, [float(30 - i) for i in range(20)])), "rsi_14d")
    assert falling[13] == 0.0


def test_rsi_frame_scope_sees_the_symbol_before(spark):
    df = series(spark, [float(i) for i in range(1, 21)], "A").unionByName(series(spark, [float(40 - i) for i in range(20)], "B"))
    own, frame = column(bars.rsi(df), "rsi_14d"), column(bars.rsi(df, scope="frame"), "rsi_14d")
    assert own[20:33] == [None] * 13 and None not in frame[20:33]
    assert frame[20] == 100.0 and own[34:] == frame[34:]


def test_labels_are_strict_and_last_row_has_none(spark):
    out = bars.label_bars(series(spark, [100.0, 102.0, 103.0, 100.0]), threshold=0.0199999)
    assert column(out, "sentiment_label") == ["positive", "neutral", "negative", None]
    exact = bars.label_bars(series(spark, [1.0, 1.5]), threshold=0.5)
    assert column(exact, "sentiment_label") == ["neutral", None]


def test_labels_keep_the_source_label(spark):
    df = series(spark, [100.0, 110.0]).withColumn("sentiment_label", F.lit("neutral"))
    out = bars.label_bars(df)
    assert column(out, "source_label") == ["neutral"] * 2 and column(out, "sentiment_label") == ["positive", None]


def test_rows_of_one_day_label_each_other(spark):
    day = dt.date(2020, 1, 1)
    rows = [(1, "A", day, 100.0), (2, "A", day, 100.0), (3, "A", day + dt.timedelta(days=1), 110.0)]
    df = spark.createDataFrame(rows, "headline_id long, symbol string, date date, close double")
    out = bars.label_rows(df, ("date", "headline_id"))
    assert [r["sentiment_label"] for r in out.orderBy("headline_id").collect()] == ["neutral", "positive", None]


@pytest.mark.parametrize("horizon", [1, 4])
def test_labels_in_ranges_equal_labels_in_plain_windows(spark, horizon):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"s{i % 4}", dt.date(2020, 1, 1 + i % 9), i, round(rng.uniform(90, 110), 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "symbol string, date date, id long, close double")
    cut = RowOrder(("symbol",), ("date", "id"), ranges=6, smallest_sample=120, chunk_rows=30)
    plain = RowOrder(("symbol",), ("date", "id"), bounded=True)
    a, b = ({(r["id"], r["future_return"], r["sentiment_label"]) for r in bars.create_labels(df, order, horizon).collect()}
            for order in (cut, plain))
    assert len(a) == 500 and a == b


def test_time_stamped_bars_lose_the_calendar_bound(spark):
    df = series(spark, [1.0, 2.0]).withColumn("date", F.col("date").cast("timestamp"))
    assert not bars.order_for(df, bars.DAILY).bounded
    assert column(bars.returns(df), "price_change_1d") == [None, 1.0]


def test_empty_and_single_row(spark):
    empty = series(spark, [1.0]).limit(0)
    assert bars.add_indicators(empty).count() == 0
    one = bars.add_indicators(series(spark, [1.0])).first()
    assert all(one[c] is None for c in bars.INDICATORS)


def test_indicators_with_the_frame_scope_of_rsi(spark):
    rows = spark.range(60).selectExpr("if(id < 30, 'A', 'B') as symbol", "date_add(date'2020-01-01', cast(id % 30 as int)) as date",
                                      "100 + sin(id * 7) as close", "id as volume")
    both = bars.add_indicators(rows, rsi_scope="frame").drop("rsi_14d").exceptAll(bars.add_indicators(rows).drop("rsi_14d"))
    assert both.count() == 0
    want = {(r["symbol"], r["date"]): r["rsi_14d"] for r in bars.rsi(rows, scope="frame").collect()}
    got = {(r["symbol"], r["date"]): r["rsi_14d"] for r in bars.add_indicators(rows, rsi_scope="frame").collect()}
    assert got == want and any(v is not None for (s, d), v in got.items() if s == "B" and d.day < 10)


def test_indicators_have_no_frame_that_is_gone_through_for_each_row(spark):
    plan = bars.add_indicators(series(spark, [1.0, 2.0]))._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" in plan and not re.search(r"RowFrame, -\d+, currentrow", plan)


@pytest.mark.parametrize("block", [1, 2, 5, 30])
def test_moving_equals_sliding_frames(spark, block):
    rng = random.Random(7)
    prices = [None if rng.random() < 0.02 else 1e6 + rng.random() for _ in range(150)] + [0.1] * 60
    df = series(spark, prices, volumes=[rng.randrange(10**9) for _ in prices]).unionByName(series(spark, [3.5] * 6, "B"))
    spec = bars.DAILY.window()
    wanted = {f"{a.__name__}_{c}_{n}": (a, c, n) for a in (F.avg, F.stddev_samp) for c in ("close", "volume") for n in (2, 5, 7, 20, 50)}
    got = bars.moving(df, spec, wanted, block).collect()
    want = {(r["symbol"], r["date"]): r for r in df.withColumns({n: bars.full_window(*w[:2], spec, w[2]) for n, w in wanted.items()}).collect()}
    assert len(got) == 216 and list(got[0].asDict()) == [*df.columns, *wanted]
    for r in got:
        for n in wanted:
            other = want[r["symbol"], r["date"]][n]
            assert r[n] == other if other is None else r[n] == pytest.approx(other, rel=1e-8, abs=1e-12)
    flat = [r["stddev_samp_close_20"] for r in got if r["symbol"] == "A" and r["date"] > dt.date(2020, 1, 1) + dt.timedelta(days=2 * 170)]
    assert flat and set(flat) == {0.0}


def test_moving_keeps_decimals(spark):
    df = series(spark, [float(i) for i in range(30)]).withColumn("close", F.col("close").cast("decimal(12,2)"))
    got, want = (f(df, F.avg, "close", 20, "x") for f in (bars.rolling, lambda d, a, c, n, into: d.withColumn(into, bars.full_window(a, c, bars.DAILY.window(), n))))
    assert got.schema == want.schema and column(got, "x") == column(want, "x")
