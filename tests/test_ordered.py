"""Range-wise computation against plain windows, with one hot key and one hot day."""

import random

import pytest
from pyspark.sql import Window, functions as F

from quillbar.operators.ordered import RowOrder, range_bounds, range_of

SMALL = {"ranges": 7, "smallest_sample": 150, "chunk_rows": 40}


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one symbol and day, another part in the same symbol, single rows."""
    rng = random.Random(5)
    rows = [("hot", 7, i) for i in range(200)] + [("hot", rng.randrange(20), 1000 + i) for i in range(150)]
    rows += [(f"s{rng.randrange(6)}", rng.randrange(20), 5000 + i) for i in range(240)] + [("single", 3, 9999)]
    rows = [(s, d, i, None if rng.random() < 0.2 else round(rng.uniform(50, 150), 2), rng.uniform(-0.3, 0.3)) for s, d, i in rows]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, day int, id long, price double, r double").repartition(5).cache()


def same(a, b, digits=9):
    def norm(df):
        return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).fillna(-99).collect())
    assert norm(a) == norm(b)


@pytest.fixture(params=[("symbol",), ()])
def orders(request):
    keys = request.param
    order = ("day", "id") if keys else ("symbol", "day", "id")
    return RowOrder(keys, order, **SMALL), RowOrder(keys, order, bounded=True)


def test_bounds_spread_rows_and_repeat(spark, skewed):
    cols = ["symbol", "day", "id"]
    bounds = range_bounds(skewed, cols, 7, 150)
    assert bounds == range_bounds(skewed.repartition(3), cols, 7, 150)
    sizes = skewed.groupBy(range_of(skewed, cols, bounds).alias("b")).count().collect()
    assert len(sizes) == 7 and max(r["count"] for r in sizes) < 200


def test_small_table_needs_no_bounds(skewed):
    assert range_bounds(skewed, ["symbol", "day", "id"]) == []


def test_positions(skewed, orders):
    same(orders[0].positions(skewed), orders[1].positions(skewed))


def test_frames_reach_over_chunk_edges(skewed, orders):
    def add(df, w):
        return df.withColumns({"a": F.avg("r").over(w.rowsBetween(-30, 0)), "b": F.lead("r", 25).over(w), "c": F.lag("r", 38).over(w)})
    same(orders[0].frames(skewed, 38, 25, add), orders[1].frames(skewed, 38, 25, add))


def test_frames_refuse_reach_beyond_chunk(skewed):
    with pytest.raises(ValueError):
        RowOrder(("symbol",), ("day", "id"), **SMALL).frames(skewed, 41, 0, lambda d, w: d)


def test_previous_keeps_nulls_apart(skewed, orders):
    a = orders[0].previous(skewed, {"price": "last", "r": "last_r"}, {"price": "known"})
    same(a, orders[1].previous(skewed, {"price": "last", "r": "last_r"}, {"price": "known"}))
    w = orders[0].window()
    same(a, skewed.withColumns({"last": F.lag("price").over(w), "last_r": F.lag("r").over(w),
                                "known": F.last("price", True).over(w.rowsBetween(Window.unboundedPreceding, -1))}))


def test_following(skewed, orders):
    same(orders[0].following(skewed, "price", "next"), skewed.withColumn("next", F.lead("price").over(orders[0].window())))


def test_fill_forward(skewed, orders):
    w = orders[0].window().rowsBetween(Window.unboundedPreceding, 0)
    same(orders[0].fill_forward(skewed, "price", "full"), skewed.withColumn("full", F.last("price", True).over(w)))


@pytest.mark.parametrize("start", [False, True])
def test_compound(skewed, orders, start):
    same(orders[0].compound(skewed, "r", start), orders[1].compound(skewed, "r", start), 8)


def test_compound_with_losses_beyond_all(skewed):
    wild = skewed.withColumn("r", F.when(F.col("id") % 50 == 0, -2.5).otherwise(F.col("r")))
    a, b = RowOrder((), ("symbol", "day", "id"), **SMALL), RowOrder((), ("symbol", "day", "id"), bounded=True)
    same(a.compound(wild, "r"), b.compound(wild, "r"), 7)


def test_running_sum(skewed, orders):
    same(orders[0].running_sum(skewed, {"r": "total"}), orders[1].running_sum(skewed, {"r": "total"}))


def test_null_keys_stay(spark, skewed):
    df = skewed.withColumn("symbol", F.when(F.col("symbol") != "hot", F.col("symbol")))
    out = RowOrder(("symbol",), ("day", "id"), **SMALL).positions(df)
    assert out.count() == df.count() and out.where("_pos is null").count() == 0


def test_values_with_quotes_in_bounds(spark):
    rows = [(f"it's \\ {i:03d}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int")
    out = RowOrder((), ("k", "i"), ranges=5, smallest_sample=100).positions(df)
    assert out.where("_pos != i").count() == 0
