"""Chronological splits.

A split by position only needs the keys of the cut rows. They are found with counts per date and a
look at one date each; the rows themselves are then labelled by comparing their key with the cuts,
without any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillbar.operators.ordered import range_bounds, range_of

DIRECT_ROWS = 1_000_000


def require_days(df: DataFrame, date: str) -> None:
    """Splits read the list of dates, which is short only for whole days."""
    if df.schema[date].dataType.typeName() != "date":
        raise ValueError(f"{date} must be of type date")


def cut_counts(rows: int, fractions: Sequence[float]) -> list[int]:
    """How many rows lie before each cut: ``int(n * f1)``, ``int(n * (f1 + f2))``."""
    total, out = 0.0, []
    for f in fractions[:-1]:
        total = total + f if out else f
        out.append(int(rows * total))
    return out


def key_at(df: DataFrame, key: str, place: int, rows: int, direct_rows: int = DIRECT_ROWS):
    """The key at a 0-based place in key order. Large sets are first narrowed to one key range."""
    keys = df.select(key)
    while rows > direct_rows:
        bounds = range_bounds(keys, [key], rows=rows)
        placed = keys.withColumn("_range", range_of(keys, [key], bounds))
        counts = placed.groupBy("_range").count().orderBy("_range").collect()
        if len(counts) < 2:  # one key value, or bounds that no longer cut
            break
        for r in counts:
            if place < r["count"]:
                keys, rows = placed.where(F.col("_range") == r["_range"]).select(key), r["count"]
                break
            place -= r["count"]
    return keys.orderBy(key).offset(place).limit(1).first()[0]


def cut_keys(df: DataFrame, date: str, key: str, fractions: Sequence[float], snap: str = "row",
             direct_rows: int = DIRECT_ROWS) -> list[tuple]:
    """The (date, key) of the first row after each cut; key None means the start of that date. Rows without a
    date come last. A cut past the last row is None."""
    require_days(df, date)
    days = df.groupBy(date).count().orderBy(F.col(date).asc_nulls_last()).collect()
    rows = sum(d["count"] for d in days)
    cuts = []
    for place in cut_counts(rows, fractions):
        seen, found = 0, None
        for d in days:
            if place < seen + d["count"]:
                first = None
                if snap == "row" and place > seen:
                    first = key_at(df.where(F.col(date).eqNullSafe(F.lit(d[date]))), key, place - seen, d["count"], direct_rows)
                found = (d[date], first)
                break
            seen += d["count"]
        cuts.append(found)
    return cuts


def is_before(date: str, key: str, cut: tuple | None) -> Column:
    if cut is None:
        return F.lit(True)
    day, first = cut
    earlier = F.col(date).isNotNull() if day is None else F.coalesce(F.col(date) < F.lit(day), F.lit(False))
    if first is None:
        return earlier
    return earlier | (F.col(date).eqNullSafe(F.lit(day)) & F.coalesce(F.col(key) < F.lit(first), F.lit(True)))


def time_split(df: DataFrame, date: str = "date", key: str = "headline_id",
               fractions: Sequence[float] = (0.7, 0.15, 0.15), snap: str = "row",
               direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Add ``split``: train, val or test, by place in (date, key) order.

    The last fraction is what remains. ``snap='date'`` keeps every day whole, in the later part.
    """
    train, val = cut_keys(df, date, key, fractions, snap, direct_rows)
    return df.withColumn("split", F.when(is_before(date, key, train), "train")
                         .when(is_before(date, key, val), "val").otherwise("test"))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def fold_table(df: DataFrame, date: str = "date", folds: int = 5, test_size: float = 0.2, gap_days: int = 1,
               purge_days: int = 0, embargo_days: int = 0) -> list[dict]:
    """Walk-forward folds over the distinct dates.

    The test block is ``test_size`` of the dates split evenly over the folds at the end of the
    calendar; training takes the dates before it, less ``gap_days + purge_days`` calendar days.
    ``embargo_days`` after the block are never used for training in that fold.
    """
    require_days(df, date)
    dates = [r[0] for r in df.select(date).distinct().orderBy(date).collect()]
    block = max(1, math.floor(len(dates) * test_size / folds))
    out = []
    for i in range(folds):
        start = len(dates) - (folds - i) * block
        if start <= 0:
            continue
        out.append({"fold": i, "test_start": dates[start], "test_end": dates[start + block - 1],
                    "train_gap": gap_days + purge_days, "embargo": embargo_days})
    return out


def _folds_of(df: DataFrame, folds: list[dict], date: str, later_training: bool) -> DataFrame:
    """One row per (input row, fold it belongs to), with its part. At most one copy per fold."""
    day = F.col(date)
    parts = []
    for f in folds:
        start, end = F.lit(f["test_start"]), F.lit(f["test_end"])
        train = day < F.date_sub(start, f["train_gap"])
        if later_training:
            train = train | (day > F.date_add(end, f["embargo"]))
        part = F.when(day.between(start, end), "test").when(train, "train")
        parts.append(F.when(part.isNotNull(), F.struct(F.lit(f["fold"]).alias("fold"), part.alias("part"))))
    return df.withColumn("_f", F.explode(F.array_compact(F.array(*parts)))).select("*", "_f.fold", "_f.part").drop("_f")


def cv_time_series(df: DataFrame, date: str = "date", folds: int = 5, test_size: float = 0.2, gap_days: int = 1) -> DataFrame:
    """Walk-forward folds: training dates lie before the test block, less a gap."""
    return _folds_of(df, fold_table(df, date, folds, test_size, gap_days), date, False)


def cv_purged(df: DataFrame, date: str = "date", folds: int = 5, test_size: float = 0.2, purge_days: int = 5,
              embargo_days: int = 5) -> DataFrame:
    """Purged folds: training dates lie on both sides of the test block, less a purge before and an
    embargo after it."""
    return _folds_of(df, fold_table(df, date, folds, test_size, 0, purge_days, embargo_days), date, True)
