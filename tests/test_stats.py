import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillbar.operators import stats

DAY = dt.date(2020, 1, 1)


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0), (0.0, 0.5), (None, 1.0)], "y double, p double")
    got = stats.regression_metrics(df, "y", "p").first()
    assert got["n"] == 4 and got["mse"] == pytest.approx(2.25 / 4) and got["mae"] == pytest.approx(2.5 / 4)
    assert got["rmse"] == pytest.approx(math.sqrt(2.25 / 4))
    assert got["r2"] == pytest.approx(1 - 2.25 / (4 * statistics.pvariance([1, 2, 4, 0])))
    assert got["mape"] == pytest.approx((1 + 0 + 0.25) / 3)


def scored(spark, n=400):
    rng = random.Random(3)
    rows = [(m, i, DAY + dt.timedelta(days=i % 50), int(rng.random() < p)) for i in range(n) for m, p in (("a", 0.5), ("b", 0.7))]
    return rows, spark.createDataFrame(rows, "model string, row_id long, date date, hit int")


def test_bootstrap_interval(spark):
    rows, df = scored(spark)
    got = {r["model"]: r for r in stats.bootstrap_ci(df, "hit", "date", replicates=300).collect()}
    for m in "ab":
        hits = [r[3] for r in rows if r[0] == m]
        mean, error = statistics.mean(hits), statistics.stdev(hits) / math.sqrt(len(hits))
        assert got[m]["mean"] == pytest.approx(mean) and got[m]["low"] < mean < got[m]["high"]
        assert 2 * error < got[m]["high"] - got[m]["low"] < 6 * error
    again = stats.bootstrap_ci(df.repartition(9), "hit", "date", replicates=300)
    assert {r["model"]: r["low"] for r in again.collect()} == {m: got[m]["low"] for m in got}
    assert stats.bootstrap_ci(df, "hit", "date", (), 50).columns == ["mean", "low", "high"]


def test_poisson_weights(spark):
    df = spark.range(20000).select(stats.poisson_weight(F.rand(1)).alias("w"))
    mean, var = df.agg(F.avg("w"), F.var_samp("w")).first()
    assert mean == pytest.approx(1, abs=0.03) and var == pytest.approx(1, abs=0.05)


def test_paired_t(spark):
    rows, df = scored(spark)
    by = {m: {r[1]: r[3] for r in rows if r[0] == m} for m in "ab"}
    d = [by["b"][i] - by["a"][i] for i in by["a"]]
    got = stats.paired_t(df, "hit", "row_id", "a", ["b"]).first()
    assert got["t"] == pytest.approx(statistics.mean(d) / (statistics.stdev(d) / math.sqrt(len(d))))


def test_diebold_mariano(spark):
    rng = random.Random(8)
    d = [rng.gauss(0.1, 1) for _ in range(60)]
    df = spark.createDataFrame([("b", DAY + dt.timedelta(days=i), x) for i, x in enumerate(d)], "model string, date date, d double")
    m, n = statistics.mean(d), len(d)
    def cov(k):
        return sum((d[i] - m) * (d[i - k] - m) for i in range(k, n)) / n
    var = cov(0) + 2 * sum((1 - k / 4) * cov(k) for k in range(1, 4))
    assert stats.diebold_mariano(df, lags=3).first()["dm"] == pytest.approx(m / math.sqrt(var / n))


def test_reality_check(spark):
    rng = random.Random(8)
    rows = [(m, DAY + dt.timedelta(days=i), rng.gauss(mu, 1)) for m, mu in (("good", 1.0), ("bad", -1.0)) for i in range(80)]
    df = spark.createDataFrame(rows, "model string, date date, d double")
    good = stats.reality_check(df, replicates=200).first()
    bad = stats.reality_check(df.where("model = 'bad'"), replicates=200).first()
    assert good["p_value"] < 0.05 < 0.5 < bad["p_value"]
    assert good["statistic"] == pytest.approx(math.sqrt(80) * statistics.mean(r[2] for r in rows if r[0] == "good"))


def test_units_must_be_few(spark, monkeypatch):
    monkeypatch.setattr(stats, "MOST_ROWS", 10)
    with pytest.raises(ValueError):
        stats.replicate_units(spark.range(11).withColumnRenamed("id", "u"), "u", 5)
