"""What the plans must look like to hold at scale."""

from pyspark.sql import functions as F

from quillbar.operators import align, bars, lexicon, summary
from quillbar.operators.ordered import RowOrder, range_bounds
from quillbar.plans import workflow
from quillbar.session import materialize
from quillbar.sources import inputs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_indicators_shuffle_once(spark, tmp_path):
    spark.range(100).selectExpr("'A' as symbol", "date_add(date'2020-01-01', cast(id as int)) as date",
                                "1.0D + id as close", "id as volume").write.parquet(str(tmp_path / "b"))
    text = plan(bars.add_indicators(spark.read.parquet(str(tmp_path / "b"))))
    assert text.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in text


def test_range_path_moves_the_rows_once(spark):
    rows = spark.range(500).selectExpr("if(id % 3 = 0, 'hot', concat('s', id % 50)) as symbol", "id % 7 as day", "id", "1.0D + id as close")
    order = RowOrder(("symbol",), ("day", "id"), ranges=6, smallest_sample=100)
    text = plan(order.following(rows, "close", "next"))
    assert text.count("Exchange shufflepartitionidpassthrough") == 1
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text and "SinglePartition" not in text


def test_whole_table_order_has_no_single_task_window_over_rows(spark):
    rows = spark.range(500).selectExpr("id", "0.001D as r")
    order = RowOrder((), ("id",), ranges=6, smallest_sample=100)
    out = order.compound(rows, "r")
    assert plan(out).count("Exchange SinglePartition") == 1  # the table of ranges
    assert abs(out.agg(F.max("equity")).first()[0] - 1.001 ** 500) < 1e-9


def test_bounds_come_from_a_threshold_and_not_from_a_top_k(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id % 10 as k", "id")
    seen = []
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: seen.append(plan(self)) or collect(self))
    assert len(range_bounds(rows, ["k", "id"], 4, 100)) == 3
    assert seen and not any("TakeOrdered" in text or "GlobalLimit" in text for text in seen)


def test_interpolation_looks_ahead_without_an_open_frame(spark):
    bars_table = spark.range(50).selectExpr("'A' as symbol", "date_add(date'2020-01-01', cast(id as int)) as date", "1.0D as close")
    daily = bars_table.where("day(date) % 5 = 0").selectExpr("symbol", "date", "0.5D as sentiment")
    assert "unboundedfollowing" not in plan(align.interpolate(bars_table, daily)).lower()


def test_text_queries_move_no_text_for_its_own_sake(spark, sf_dir):
    heads = inputs.headlines(spark, sf_dir)
    assert "RoundRobin" not in plan(summary.add_entity_flags(summary.headline_shape(heads)))


def test_texts_are_tokenized_once(spark, sf_dir):
    heads = inputs.headlines(spark, sf_dir)
    text = plan(lexicon.polarity(heads, "headline_id", "headline", inputs.lexicon(spark))).split("Initial Plan")[-1]
    assert text.count("regexp_extract_all") == 1


def test_checkpoint_cuts_the_lineage(spark):
    out = materialize(spark.range(10).groupBy((F.col("id") % 2).alias("k")).count())
    assert "Exchange" not in plan(out) and out.count() == 2
    assert spark.sparkContext.getCheckpointDir() is not None


def test_texts_are_joined_before_they_are_tokenized(spark, sf_dir, monkeypatch):
    written = []
    monkeypatch.setattr(workflow, "materialize", lambda df: written.append(df) or materialize(df))
    workflow.compare_models(inputs.headlines(spark, sf_dir), inputs.bars(spark, sf_dir), inputs.lexicon(spark), inputs.NEGATIONS,
                            inputs.BOOSTERS, models=("polarity",))
    plan = next(w for w in written if "_tokens" in w.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_tokens") < plan.index("Join Inner") and "regexp" not in plan[plan.index("Join Inner"):]
