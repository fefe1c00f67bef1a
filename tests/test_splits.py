import datetime as dt
import random

import pytest

from quillbar.operators import splits


def dated(spark, n, days, seed=1):
    rng = random.Random(seed)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=rng.choice(days)), rng.randrange(10 ** 12)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "date date, id long")


def expected(rows, fractions):
    ordered, n = sorted(rows), len(rows)
    a, b = int(n * fractions[0]), int(n * (fractions[0] + fractions[1]))
    return {r: "train" if i < a else "val" if i < b else "test" for i, r in enumerate(ordered)}


@pytest.mark.parametrize("n, days", [(101, list(range(30))), (97, [3] * 9 + [1, 5]), (1, [0]), (7, [2])])
@pytest.mark.parametrize("fractions", [(0.7, 0.15, 0.15), (0.5, 0.5, 0.0), (0.0, 0.3, 0.7)])
@pytest.mark.parametrize("direct", [1_000_000, 3])
def test_split_by_position(spark, n, days, fractions, direct):
    rows, df = dated(spark, n, days)
    got = {(r["date"], r["id"]): r["split"] for r in splits.time_split(df, "date", "id", fractions, direct_rows=direct).collect()}
    assert got == expected(rows, fractions)


def test_narrowing_to_a_key_range(spark, monkeypatch):
    rows, df = dated(spark, 400, [4])
    monkeypatch.setattr(splits, "range_bounds", lambda d, c, **k: [(10 ** 11 * k,) for k in range(1, 9)])
    got = {(r["date"], r["id"]): r["split"] for r in splits.time_split(df, "date", "id", direct_rows=5).collect()}
    assert got == expected(rows, (0.7, 0.15, 0.15))


def test_snap_keeps_days_whole(spark):
    _, df = dated(spark, 200, list(range(6)))
    parts = splits.time_split(df, "date", "id", snap="date")
    assert parts.groupBy("date").agg({"split": "count"}).count() == parts.select("date", "split").distinct().count()


def test_split_adds_no_shuffle(spark):
    _, df = dated(spark, 50, [1, 2, 3])
    plan = splits.time_split(df, "date", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_time_stamps_are_refused(spark):
    _, df = dated(spark, 5, [1])
    with pytest.raises(ValueError):
        splits.time_split(df.withColumn("date", df.date.cast("timestamp")), "date", "id")


def test_folds_leave_gaps(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), i) for i in range(100)], "date date, id long")
    walk = splits.cv_time_series(df).collect()
    for fold in range(5):
        train = [r["id"] for r in walk if r["fold"] == fold and r["part"] == "train"]
        test = [r["id"] for r in walk if r["fold"] == fold and r["part"] == "test"]
        assert test == list(range(80 + 4 * fold, 84 + 4 * fold)) and max(train) == test[0] - 2
    purged = splits.cv_purged(df).collect()
    train = sorted(r["id"] for r in purged if r["fold"] == 1 and r["part"] == "train")
    assert train == list(range(0, 79)) + list(range(93, 100))


@pytest.mark.parametrize("without", [20, 80])
def test_rows_without_a_date_come_last(spark, without):
    rows = spark.range(100).selectExpr("id as headline_id", f"if(id < {without}, null, date_add(date'2020-01-01', cast(id % 7 as int))) as date")
    got = {r["split"]: r["n"] for r in splits.split_sizes(splits.time_split(rows)).collect()}
    assert got == {"train": 70, "val": 15, "test": 15}
    late = splits.time_split(rows).where("date is null")
    assert late.where("split = 'test'").count() == 15
