"""The as-of join on time stamps, on ranges forced small."""

import bisect
import datetime
import random

import pytest

from quillbar.operators import align
from quillbar.operators.ordered import RowOrder

START = datetime.datetime(2024, 1, 1)


def moment(second):
    return None if second is None else START + datetime.timedelta(seconds=second)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    symbol = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
    ticks = [(i, symbol(), rng.randrange(4000), float(i)) for i in range(3000)] + [(9000, "hot", None, 1.0), (9001, "unseen", 5, 1.0)]
    points = [(i, symbol(), rng.randrange(4000), rng.choice([None, rng.random()])) for i in range(900)] + [(9500, "hot", None, 1.0)]
    # a stretch without points: values are carried over whole ranges
    points = [p for p in points if p[1] != "hot" or p[2] is None or not 1000 < p[2] < 3000]
    frames = [spark.createDataFrame([(i, s, moment(t), v) for i, s, t, v in rows], f"{key} long, symbol string, ts timestamp, {value} double")
              for rows, key, value in ((ticks, "row_id", "_key"), (points, "point_id", "value"))]
    return ticks, points, *frames


@pytest.mark.parametrize("strict,within,ranges", [(False, None, 25), (True, None, 25), (False, 40.0, 7), (True, 3.0, None)])
def test_asof_ticks(spark, tables, strict, within, ranges):
    ticks, points, left, right = tables
    known = {}
    for i, s, t, v in sorted((p for p in points if p[1] is not None and p[2] is not None), key=lambda p: (p[2], p[0])):
        known.setdefault(s, []).append((t, v))
    want = {}
    for i, s, t, _ in ticks:
        times = [k for k, _ in known.get(s, [])]
        place = 0 if t is None else (bisect.bisect_left if strict else bisect.bisect_right)(times, t)
        at, v = known[s][place - 1] if place else (None, None)
        seen = place and (within is None or t - at <= within)
        want[i] = (v, float(t - at)) if seen else (None, None)
    small = 10_000 if ranges is None else 50
    got = align.asof_ticks(left, right, strict=strict, within=within, ranges=ranges, smallest_sample=small)
    assert got.columns == ["row_id", "symbol", "ts", "_key", "value", "age_seconds"]
    rows = got.collect()
    assert len(rows) == len(ticks) and {r["row_id"]: (r["value"], r["age_seconds"]) for r in rows} == want


def test_a_hot_symbol_is_many_ranges(spark, tables):
    left = tables[2]
    bounds = RowOrder(("symbol",), ("ts", "row_id"), ranges=25, smallest_sample=500).settle(left).bounds
    assert sum(b[0] == "hot" for b in bounds) >= 8


def test_empty_tables(spark, tables):
    _, _, left, right = tables
    assert align.asof_ticks(left.limit(0), right).count() == 0
    alone = align.asof_ticks(left, right.limit(0)).collect()
    assert len(alone) == left.count() and all(r["value"] is None for r in alone)
