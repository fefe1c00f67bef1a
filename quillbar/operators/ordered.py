"""Row-ordered computation that never puts an unbounded group into one task.

A window over ``partitionBy(symbol).orderBy(date)`` is fine as long as a symbol's rows are few.
With many headlines per day one symbol, or one day, may hold a large share of all rows. The
functions here then work in three steps:

1. the rows are cut into ranges of the full order key, at bounds taken from a sample;
2. windows run within a range;
3. a key that goes on from one range into the next is the key of the bound between them. Such keys
   are summarised per range, a prefix over the summaries gives each range what came before it, and
   that table, at most one row per range, is broadcast to the rows.

So the rows are shuffled once. The input is read once for the bounds, once for the summaries and
once for the result, each time with only the columns needed. Give it a materialised table where it
is costly to compute.

The sample is chosen by a hash of the order key, so the bounds depend on the data alone and the
range of a row is the same wherever and however often it is computed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F
from pyspark.sql.types import DataType

from quillbar.session import shuffle_width

SAMPLE_PER_RANGE = 20
SMALLEST_SAMPLE = 10_000
RANGE_ROWS = 2_000_000


def _literal(value, dtype: DataType) -> str:
    if value is None:
        return f"cast(null as {dtype.simpleString()})"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"cast('{text}' as {dtype.simpleString()})"


def range_bounds(df: DataFrame, cols: Sequence[str], ranges: int | None = None,
                 smallest_sample: int = SMALLEST_SAMPLE, rows: int | None = None) -> list[tuple]:
    """Ascending cut points of the order key ``cols``; none if the table is small.

    There are twice as many ranges as shuffle partitions, or more, so that none has much over RANGE_ROWS
    rows. The sample is the rows whose key hash is below a threshold: about the wanted number in all, found
    by every task for itself, and the same rows each time. Only its distinct keys reach the driver.
    """
    keys = df.select(*cols)
    rows = keys.count() if rows is None else rows
    ranges = ranges or max(2 * shuffle_width(df.sparkSession), -(-rows // RANGE_ROWS))
    size = max(ranges * SAMPLE_PER_RANGE, smallest_sample)
    if rows < size:
        return []
    limit = min(2**63 - 1, -(2**63) + (2**64 * size) // rows)
    sample = keys.where(F.xxhash64(*cols) <= F.lit(limit)).distinct().orderBy(*cols).collect()
    cuts = {i * len(sample) // ranges for i in range(1, ranges)} - {0}
    return [tuple(sample[i]) for i in sorted(cuts)]


def bound_arrays(df: DataFrame, cols: Sequence[str], bounds: Sequence[tuple]) -> list[Column]:
    """The bounds as one constant array for each column."""
    return [F.expr("array(" + ", ".join(_literal(b[i], df.schema[c].dataType) for b in bounds) + ")")
            for i, c in enumerate(cols)]


def range_of(df: DataFrame, cols: Sequence[str], bounds: Sequence[tuple]) -> Column:
    """How many bounds are at or below the row's key (a binary search).

    Keys compare column by column, nulls first, as in an ascending sort.
    """
    if not bounds:
        return F.lit(0)
    arrays = bound_arrays(df, cols, bounds)
    with_null = [any(b[i] is None for b in bounds) for i in range(len(cols))]

    def reached(index: Column) -> Column:
        out = None
        for i in reversed(range(len(cols))):
            bound, own = F.get(arrays[i], index), F.col(cols[i])
            below, same = bound < own, bound == own
            if with_null[i]:
                below = F.when(bound.isNull(), own.isNotNull()).otherwise(below)
                same = bound.eqNullSafe(own)
            out = below | same if out is None else below | (same & out)
        return (index < len(bounds)) & F.coalesce(out, F.lit(False))

    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda found, step: F.when(reached(found + step - 1), found + step).otherwise(found))


def before(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def upto(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class RowOrder:
    """How rows are ordered within each key.

    ``order`` must be unique within ``keys``. ``bounded`` states that the rows of one key are few
    by nature (one bar per symbol and day): plain windows are used, with one shuffle. Otherwise
    the order is settled first: a table smaller than the sample counts as bounded too, any other
    is cut into ranges.

    ``sample`` is a cheaper table with the key and order columns to take the bounds from. It should
    hold at least the rows of the table itself; bounds only decide how evenly work is spread.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    bounded: bool = False
    sample: DataFrame | None = None
    bounds: tuple[tuple, ...] | None = None
    ranges: int | None = None
    smallest_sample: int = SMALLEST_SAMPLE
    chunk_rows: int = 1_000_000

    def settle(self, df: DataFrame) -> RowOrder:
        if self.bounded or self.bounds is not None:
            return self
        source = df if self.sample is None else self.sample
        bounds = range_bounds(source, [*self.keys, *self.order], self.ranges, self.smallest_sample)
        return replace(self, bounds=tuple(bounds)) if bounds else replace(self, bounded=True)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def _ranged(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_range", range_of(df, [*self.keys, *self.order], self.bounds))

    def _placed(self, ranged: DataFrame) -> DataFrame:
        """Each range in a partition of its own: as even as the bounds, with no hash collisions."""
        return ranged.repartitionById(len(self.bounds) + 1, F.col("_range"))

    def _here(self) -> WindowSpec:
        return Window.partitionBy("_range", *self.keys).orderBy(*self.order)

    def _continued(self, ranged: DataFrame) -> DataFrame:
        """Rows whose key is that of the bound below or above their range."""
        if not self.keys:
            return ranged
        arrays = bound_arrays(ranged, self.keys, self.bounds)
        keep = F.lit(False)
        for index in (F.col("_range") - 1, F.col("_range")):
            same = (index >= 0) & (index < len(self.bounds))
            for array, k in zip(arrays, self.keys):
                same = same & F.get(array, index).eqNullSafe(F.col(k))
            keep = keep | same
        return ranged.where(keep)

    def _ranges_of_key(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("_range")

    def _carry(self, rows: DataFrame, ranged: DataFrame, summaries: dict[str, Column],
               carried: dict[str, Column]) -> DataFrame:
        """Join to ``rows`` what ``carried`` makes of the summaries of the key's other ranges; NULL
        for keys that lie in one range."""
        group = [*self.keys, "_range"]
        table = self._continued(ranged).groupBy(*group).agg(*[c.alias(n) for n, c in summaries.items()])
        return self._join(rows, table.withColumns(carried).select(*group, *carried))

    def _join(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """Broadcast a table with at most two rows per range."""
        group = [*self.keys, "_range"]
        other = table.withColumnsRenamed({c: f"_on_{c}" for c in group})
        match = F.lit(True)
        for c in group:
            match = match & rows[c].eqNullSafe(other[f"_on_{c}"])
        return rows.join(F.broadcast(other), match, "left").drop(*[f"_on_{c}" for c in group])

    def positions(self, df: DataFrame, name: str = "_pos") -> DataFrame:
        """Add each row's 0-based position within its key."""
        me = self.settle(df)
        if me.bounded:
            return df.withColumn(name, (F.row_number().over(me.window()) - 1).cast("long"))
        ranged = me._ranged(df)
        rows = me._carry(
            me._placed(ranged).withColumn("_row", F.row_number().over(me._here())), ranged,
            {"_n": F.count(F.lit(1))},
            {"_start": F.sum("_n").over(before(me._ranges_of_key()))})
        start = F.coalesce(F.col("_start"), F.lit(0))
        return rows.withColumn(name, start + F.col("_row") - 1).drop("_range", "_row", "_start")

    def frames(self, df: DataFrame, back: int, ahead: int,
               add: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
        """Add columns whose window frames reach ``back`` rows back and ``ahead`` rows ahead.

        Large tables are cut into chunks of ``chunk_rows`` consecutive rows of a key. Rows near the
        edge of a chunk are copied to the neighbour that needs them and dropped again afterwards.
        """
        me = self.settle(df)
        if me.bounded:
            return add(df, me.window())
        if max(back, ahead) > self.chunk_rows:
            raise ValueError("chunk_rows must be at least the reach of the frames")
        placed = me.positions(df).withColumn("_home", F.floor(F.col("_pos") / self.chunk_rows))
        offset = F.col("_pos") % self.chunk_rows
        homes = F.array_compact(F.array(
            F.col("_home"),
            F.when(offset < ahead, F.col("_home") - 1),
            F.when(offset >= self.chunk_rows - back, F.col("_home") + 1),
        ))
        copied = placed.withColumn("_chunk", F.explode(homes))
        spec = Window.partitionBy(*self.keys, "_chunk").orderBy("_pos")
        return add(copied, spec).where(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home", "_pos")

    def previous(self, df: DataFrame, last: dict[str, str], known: dict[str, str] | None = None) -> DataFrame:
        """Add values from before the row: ``last`` maps a column to its value in the row before,
        ``known`` to its last non-null value in any row before."""
        known = known or {}
        me = self.settle(df)
        spec = me.window() if me.bounded else me._here()
        own = {
            **{f"_l_{o}": F.lag(c).over(spec) for c, o in last.items()},
            **{f"_k_{o}": F.last(c, ignorenulls=True).over(before(spec)) for c, o in known.items()},
        }
        if me.bounded:
            return df.withColumns({n[3:]: c for n, c in own.items()})
        place = F.struct(*self.order)
        ranged, by_range = me._ranged(df), me._ranges_of_key()
        rows = me._carry(
            me._placed(ranged).withColumns({**own, "_first": F.lag(F.lit(True)).over(spec).isNull()}), ranged,
            {**{f"_e_{o}": F.max_by(F.struct(F.col(c).alias("v")), place) for c, o in last.items()},
             **{f"_e_{o}": F.max_by(c, F.when(F.col(c).isNotNull(), place)) for c, o in known.items()}},
            {**{f"_c_{o}": F.lag(f"_e_{o}").over(by_range)["v"] for o in last.values()},
             **{f"_c_{o}": F.last(f"_e_{o}", ignorenulls=True).over(before(by_range)) for o in known.values()}})
        return rows.withColumns({
            **{o: F.when(F.col("_first"), F.col(f"_c_{o}")).otherwise(F.col(f"_l_{o}")) for o in last.values()},
            **{o: F.coalesce(F.col(f"_k_{o}"), F.col(f"_c_{o}")) for o in known.values()},
        }).drop("_range", "_first", *own, *[f"_c_{o}" for o in (*last.values(), *known.values())])

    def following(self, df: DataFrame, column: str, into: str) -> DataFrame:
        """Add the value of ``column`` in the next row."""
        me = self.settle(df)
        if me.bounded:
            return df.withColumn(into, F.lead(column).over(me.window()))
        ranged, spec = me._ranged(df), me._here()
        rows = me._carry(
            me._placed(ranged).withColumns({"_own": F.lead(column).over(spec), "_last": F.lead(F.lit(True)).over(spec).isNull()}),
            ranged,
            {"_edge": F.min_by(F.struct(F.col(column).alias("v")), F.struct(*self.order))},
            {"_next": F.lead("_edge").over(me._ranges_of_key())["v"]})
        return rows.withColumn(into, F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_own"))).drop(
            "_range", "_own", "_last", "_next")

    def fill_forward(self, df: DataFrame, column: str, into: str) -> DataFrame:
        """Add the last known value of ``column`` at or before the row."""
        rows = self.previous(df, {}, {column: "_known"})
        return rows.withColumn(into, F.coalesce(F.col(column), F.col("_known"))).drop("_known")

    def compound(self, df: DataFrame, returns: str, include_start: bool = False) -> DataFrame:
        """Add ``equity`` (running product of 1 + return), ``peak`` and ``drawdown``.

        The peak starts at the first equity value, or at 1 with ``include_start``.
        """
        me = self.settle(df)
        growth = F.product(F.lit(1.0) + F.col(returns))
        if me.bounded:
            out = df.withColumn("equity", growth.over(upto(me.window())))
            out = out.withColumn("peak", F.max("equity").over(upto(me.window())))
        else:
            here, earlier = upto(me._here()), before(me._ranges_of_key())
            ranged = me._ranged(df)
            carry = F.coalesce(F.col("_carry"), F.lit(1.0))
            ends = (
                me._placed(me._continued(ranged)).withColumn("_grown", growth.over(here)).groupBy(*self.keys, "_range")
                .agg(growth.alias("_product"), F.max("_grown").alias("_high"), F.min("_grown").alias("_low"))
                .withColumn("_carry", F.product("_product").over(earlier))
                .withColumn("_top", F.when(carry >= 0, carry * F.col("_high")).otherwise(carry * F.col("_low")))
                .withColumn("_peak", F.max("_top").over(earlier))
                .select(*self.keys, "_range", "_carry", "_peak")
            )
            out = (
                me._join(me._placed(ranged).withColumn("_grown", growth.over(here)), ends)
                .withColumn("equity", carry * F.col("_grown"))
                .withColumn("peak", F.greatest("_peak", F.max("equity").over(here)))
                .drop("_range", "_grown", "_carry", "_peak")
            )
        if include_start:
            out = out.withColumn("peak", F.greatest("peak", F.lit(1.0)))
        return out.withColumn("drawdown", F.try_divide(F.col("equity") - F.col("peak"), F.col("peak")))

    def running_sum(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """Running totals, current row included: ``columns`` maps input to output names."""
        me = self.settle(df)
        if me.bounded:
            return df.withColumns({o: F.sum(c).over(upto(me.window())) for c, o in columns.items()})
        ranged, earlier = me._ranged(df), before(me._ranges_of_key())
        rows = me._carry(
            me._placed(ranged).withColumns({o: F.sum(c).over(upto(me._here())) for c, o in columns.items()}), ranged,
            {f"_t_{c}": F.sum(c) for c in columns},
            {f"_c_{c}": F.sum(f"_t_{c}").over(earlier) for c in columns})
        return rows.withColumns({o: F.col(o) + F.coalesce(F.col(f"_c_{c}"), F.lit(0)) for c, o in columns.items()}).drop(
            "_range", *[f"_c_{c}" for c in columns])
