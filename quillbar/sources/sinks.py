"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options) -> None:
    """Write in parallel, one file per partition. CSV gets a header; its arrays become JSON text."""
    if fmt == "csv":
        options = {"header": True, **options}
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
        df = df.withColumns({c: F.to_json(c) for c in nested})
    df.write.format(fmt).mode(mode).options(**options).save(path)
