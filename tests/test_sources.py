import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillbar.functions import fixed_values as fixed
from quillbar.operators import align, features, summary
from quillbar.plans.workflow import compare_models, labelled_rows
from quillbar.sources import bars, inputs, sinks, synth
from quillbar.streaming.headlines import tag_stream

DAY = dt.date(2020, 1, 1)


def small_bars(spark, symbols=("A", "B"), n=3):
    rows = [(DAY + dt.timedelta(days=i), s, 1.0, 2.0, 0.5, 1.5 + i, 10 + i) for s in symbols for i in range(n)]
    return spark.createDataFrame(rows, bars.BAR_SCHEMA)


def test_csv_columns_are_found_by_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,date,close,open,high,low,volume,note\nA,2020-01-02,1.5,1.0,2.0,0.5,7,x\n")
    row = bars.load_bars(spark, str(tmp_path / "a.csv"), fmt="csv").first()
    assert (row["date"], row["symbol"], row["open"], row["close"], row["volume"]) == (DAY + dt.timedelta(days=1), "A", 1.0, 1.5, 7)
    (tmp_path / "b.csv").write_text("symbol,date,close,open,high,low,volume\nA,2020-01-02,much,1.0,2.0,0.5,7\n")
    with pytest.raises(Exception):
        bars.load_bars(spark, str(tmp_path / "b.csv"), fmt="csv").collect()
    (tmp_path / "c.csv").write_text("symbol,date\nA,2020-01-02\n")
    with pytest.raises(ValueError):
        bars.load_bars(spark, str(tmp_path / "c.csv"), fmt="csv")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_write_and_load(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    sinks.write_table(small_bars(spark), path, fmt)
    assert sorted(bars.load_bars(spark, path, fmt=fmt).collect()) == sorted(small_bars(spark).collect())
    some = bars.load_bars(spark, path, ["A"], "2020-01-02", "2020-01-03", fmt=fmt).collect()
    assert [(r["symbol"], r["date"]) for r in some] == [("A", DAY + dt.timedelta(days=1))]
    with pytest.raises(Exception):
        sinks.write_table(small_bars(spark), path, fmt)


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(Exception):
        bars.load_bars(spark, str(tmp_path / "none")).count()


def test_filter_reaches_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    df = bars.load_bars(spark, f"{sf_dir}/orders.parquet", ["2-HIGH"], "1995-01-01", "1996-01-01",
                        columns={"o_orderpriority": "symbol", "o_orderdate": "date", "o_totalprice": "close"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,2-HIGH)" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_custkey" not in plan


def test_normalize(spark):
    raw = small_bars(spark).drop("symbol").withColumnsRenamed({"date": "Date", "close": "Close"})
    out = bars.normalize_columns(raw, "X")
    assert out.columns == ["date", "open", "high", "low", "close", "volume", "symbol"]
    assert {r["symbol"] for r in out.collect()} == {"X"}


def test_wide_to_long_skips_absent_symbols(spark):
    wide = spark.createDataFrame([(DAY, 1.0, None)], "date date, A_close double, B_close double")
    out = bars.wide_to_long(wide, ["A", "B", "C"], fields=["close"])
    assert sorted((r["symbol"], r["close"]) for r in out.collect()) == [("A", 1.0), ("B", None)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        bars.wide_to_long(wide, ["C"], fields=["close"])


def test_union_matches_by_name(spark):
    a = small_bars(spark, ("A",))
    assert bars.union_bars([a, a.select(*reversed(a.columns))]).where("volume < 10").count() == 0


def test_generated_headlines(spark):
    ids = synth.headline_ids(spark, 4000)
    out = synth.synth_headlines(ids).cache()
    again = synth.synth_headlines(ids.repartition(13))
    assert sorted(out.collect()) == sorted(again.collect()) and out.count() == 4000
    assert out.exceptAll(synth.synth_headlines(ids, seed=1)).count() > 3000
    shares = {r[0]: r[1] / 4000 for r in summary.label_distribution(out).collect()}
    assert all(abs(shares[c] - fixed.LABEL_SHARES[c]) < 0.03 for c in fixed.LABELS)
    assert out.where(f"not date between '{fixed.START_DATE}' and '{fixed.END_DATE}'").count() == 0
    assert out.where("not contains(headline, symbol) or headline like '%{%'").count() == 0
    focus = out.where("headline like '% with focus on %'").count() / 4000
    assert abs(focus - fixed.FOCUS_SHARE) < 0.03
    for label, words in fixed.KEYWORDS.items():
        assert out.where(F.col("sentiment_label") == label).where(~F.rlike("headline", F.lit("|".join(words)))).count() == 0
    assert out.where("text_length != length(headline) or word_count < 3").count() == 0


def test_generated_bars(spark):
    days = synth.calendar(spark)
    out = synth.synth_bars(days).cache()
    assert out.count() == 5 * 1461 == out.select("symbol", "date").distinct().count()
    assert out.where("low > least(open, close) or high < greatest(open, close) or volume < 100000").count() == 0
    assert {r["close"] for r in out.where("date = '2020-01-01'").collect()} == {100.0}
    assert sorted(out.collect()) == sorted(synth.synth_bars(days.repartition(9)).collect())
    assert synth.synth_bars_indicators(days).columns[-1] == "price_vs_ma50"


def test_impact_moves_the_next_day(spark):
    days = synth.calendar(spark, ["A"], "2020-01-01", "2020-01-10")
    news = spark.createDataFrame([("A", dt.date(2020, 1, 4), "positive"), ("A", dt.date(2020, 1, 4), "neutral")], "symbol string, date date, sentiment_label string")
    plain = {r["date"]: r["close"] for r in synth.synth_bars(days).collect()}
    moved = {r["date"]: r["close"] for r in synth.synth_bars(days, impact=synth.sentiment_impact(news)).collect()}
    for day in plain:
        assert moved[day] == pytest.approx(plain[day] * (1.01 if day > dt.date(2020, 1, 4) else 1), abs=0.011)


def test_sample_is_seeded_and_sized(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = sorted(summary.sample_rows(df, "k", 50).collect())
    assert len(set(a)) == 50 and a == sorted(summary.sample_rows(df.repartition(11), "k", 50).collect())
    assert a != sorted(summary.sample_rows(df, "k", 50, seed=1).collect())
    assert summary.sample_rows(df.limit(5), "k", 50).count() == 5


def test_alignment(spark):
    price = small_bars(spark, ("A", "B"), 6).select("symbol", "date", "close")
    daily = spark.createDataFrame([("A", DAY + dt.timedelta(days=1), 1.0), ("A", DAY + dt.timedelta(days=4), 4.0)], "symbol string, date date, sentiment double")
    def values(df, symbol="A"):
        return [r["sentiment"] for r in df.where(F.col("symbol") == symbol).orderBy("date").collect()]
    assert values(align.overlay(price, daily)) == [None, 1.0, None, None, 4.0, None]
    assert values(align.asof(price, daily)) == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert values(align.interpolate(price, daily)) == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert values(align.interpolate(price, daily), "B") == [None] * 6
    assert align.join_bars(daily, price).count() == 2


def test_feature_table(spark):
    heads = spark.createDataFrame([(1, "A", DAY, "Revenue growth of $5"), (2, "A", DAY, "nothing"), (3, "Z", DAY, "x")], "headline_id long, symbol string, date date, headline string")
    scores = spark.createDataFrame([(1, 0.5)], "headline_id long, model_sentiment double")
    out = features.feature_table(heads, small_bars(spark), inputs.lexicon(spark), inputs.NEGATIONS, inputs.BOOSTERS, model_scores=scores)
    got = {r["headline_id"]: r for r in out.collect()}
    assert set(got) == {1, 2} and got[1]["has_earnings_keywords"] and got[1]["model_sentiment"] == 0.5
    assert got[1]["sentiment_polarity"] == pytest.approx(0.2) and got[2]["word_count"] == 1


def test_stream(spark, tmp_path):
    heads = spark.createDataFrame([(1, "Merger DEAL https://x.y"), (2, "up 5%")], "id long, headline string")
    heads.write.parquet(str(tmp_path / "in"))
    stream = tag_stream(spark.readStream.schema(heads.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.collect()) == sorted(tag_stream(heads).select(*got.columns).collect())


def news(spark, n=600):
    return synth.synth_headlines(synth.headline_ids(spark, n), end="2020-06-30"), synth.synth_bars(synth.calendar(spark, end="2020-06-30"))


@pytest.mark.parametrize("label_on", ["headline", "bar"])
@pytest.mark.parametrize("returns_from", ["rows", "bars"])
def test_end_to_end(spark, label_on, returns_from):
    heads, prices = news(spark)
    out = compare_models(heads, prices, inputs.lexicon(spark), inputs.NEGATIONS, inputs.BOOSTERS,
                         models=("polarity", "naive_bayes", "majority", "random"), label_on=label_on, returns_from=returns_from)
    got = out.collect()
    assert {r["model"] for r in got} == {"polarity", "naive_bayes", "majority", "random"}
    assert all(0 <= r["accuracy"] <= 1 and r["total_return"] is not None for r in got)
    assert [r["accuracy"] for r in got] == sorted((r["accuracy"] for r in got), reverse=True)


def test_all_scorers_end_to_end(spark):
    heads, prices = news(spark, 300)
    out = compare_models(heads, prices, inputs.lexicon(spark), inputs.NEGATIONS, inputs.BOOSTERS,
                         models=("valence", "logistic", "custom"), scorer=inputs.count_scorer, scope="date")
    assert out.count() == 3


def test_bar_labels_differ_only_on_shared_days(spark):
    heads, prices = news(spark, 200)
    assert labelled_rows(heads, prices, label_on="bar").count() >= labelled_rows(heads, prices).count()
    with pytest.raises(ValueError):
        labelled_rows(heads, prices, label_on="x")
