"""Reading, normalising and joining up bar tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAR_SCHEMA = "date date, symbol string, open double, high double, low double, close double, volume long"
FIELDS = ["open", "high", "low", "close", "volume"]


def load_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start: str | None = None,
              end: str | None = None, fmt: str = "parquet", columns: dict[str, str] | None = None,
              **options) -> DataFrame:
    """Bars from Parquet, CSV or JSON files. Missing or unreadable input raises.

    ``columns`` maps the file's column names to bar columns; only those are read. Without it the
    files have the bar schema. CSV columns are found by the header, in any order; a cell that does not
    fit its type raises, as does a file whose header differs from the others'.
    """
    reader = spark.read.options(**options).format(fmt)
    if fmt == "csv" and "header" not in options:
        reader = reader.option("header", True)
    if columns is None and fmt == "csv" and str(options.get("header", True)).lower() == "true":
        return filter_bars(_csv_by_header(reader, path), symbols, start, end)
    if columns is None:
        return filter_bars(reader.schema(BAR_SCHEMA).load(path), symbols, start, end)
    named = reader.load(path).select(*[F.col(c).alias(n) for c, n in columns.items()])
    return filter_bars(named, symbols, start, end).withColumn("date", F.to_date("date"))


def _csv_by_header(reader, path: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in StructType.fromDDL(BAR_SCHEMA)}
    header = reader.load(path).columns
    missing = [name for name in kinds if name not in header]
    if missing:
        raise ValueError(f"columns missing in the header: {', '.join(missing)}")
    schema = StructType([StructField(name, kinds.get(name, StringType())) for name in header])
    return reader.option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).load(path).select(*kinds)


def filter_bars(bars: DataFrame, symbols: Sequence[str] | None = None, start: str | None = None,
                end: str | None = None) -> DataFrame:
    """Rows of the symbols with ``start <= date < end``.

    The limits take the type of the date column, so that the comparison reaches the file scan.
    """
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(list(symbols)))
    kind = bars.schema["date"].dataType
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast(kind))
    if end is not None:
        bars = bars.where(F.col("date") < F.lit(end).cast(kind))
    return bars


def normalize_columns(bars: DataFrame, symbol: str | None = None) -> DataFrame:
    """Lower-case column names; add the symbol of a single-symbol table."""
    out = bars.withColumnsRenamed({c: c.lower() for c in bars.columns})
    return out if symbol is None else out.withColumn("symbol", F.lit(symbol))


def wide_to_long(wide: DataFrame, symbols: Sequence[str], date: str = "date", fields: Sequence[str] = tuple(FIELDS),
                 separator: str = "_") -> DataFrame:
    """One row per (date, symbol) from columns named ``<symbol>_<field>``.

    Symbols without columns are skipped. Each input row is expanded in place: no shuffle.
    """
    present = [s for s in symbols if all(f"{s}{separator}{f}" in wide.columns for f in fields)]
    if not present:
        raise ValueError("none of the symbols has columns in the table")
    groups = F.array(*[
        F.struct(F.lit(s).alias("symbol"), *[F.col(f"`{s}{separator}{f}`").alias(f) for f in fields])
        for s in present
    ])
    return wide.select(F.col(date).alias("date"), F.inline(groups))


def union_bars(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of the parts, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)
