"""Small DataFrame helpers of the operators."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK_BYTES = 8 << 20
"""Documents are dealt into blocks of about this much text; one task holds one block at a time."""


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def width(spark: SparkSession) -> int:
    value = spark.conf.get("spark.sql.shuffle.partitions", "200")
    return int(value) if value.isdigit() else 200


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own; a cluster must name one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """Compute a table once and keep it in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def blocks_for(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of ``block_bytes`` the texts fill; at least one for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(math.ceil(total / block_bytes), width(docs.sparkSession))


def block_of(blocks: int, key: str, text: str) -> Column:
    """A row's block: by its key, or by its text where it has no key."""
    return F.pmod(F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.xxhash64(text)), F.lit(blocks)).cast("int")


HOT_ROWS = 10_000
MOST_HOT = 100_000


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows with the columns of their group (an inner join on ``keys``; ``size`` is a group's number of rows).

    A group of more than ``hot_rows`` rows and more than a part in ``MOST_HOT`` of all rows is broadcast: there are fewer than ``MOST_HOT`` of
    those at any size of the table. The others meet their rows by shuffle, and none is large. ``rows`` is read twice; a row of ``groups``
    should have a fixed width.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(hot_rows, total // MOST_HOT)
    near = rows.join(F.broadcast(groups.where(F.col(size) > limit)), keys, "left")
    far = near.where(F.col(size).isNull()).select(rows.columns).join(groups.where(F.col(size) <= limit), keys)
    return near.where(F.col(size).isNotNull()).unionByName(far)


RUN_ROWS = 1 << 16


def repeated(rows: DataFrame, copies: str, number: str) -> DataFrame:
    """Every row ``copies`` times, numbered from 1. Many copies of one row are written by many tasks."""
    runs = F.sequence(F.lit(0), ((F.col(copies) - 1) / RUN_ROWS).cast("long"))
    (run,) = fresh(rows, "run")
    dealt = rows.withColumn(run, F.explode(runs)).repartition(width(rows.sparkSession), F.xxhash64(*rows.columns, run))
    here = F.sequence(F.col(run) * RUN_ROWS + 1, F.least((F.col(run) + 1) * RUN_ROWS, F.col(copies)))
    return dealt.withColumn(number, F.explode(here)).drop(run)
