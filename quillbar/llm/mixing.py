"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of all words, by weight, but at most ``MOST_COPIES`` times its own words; what is over is shared among the
others by weight until none is above. Every document of a source is wanted ``target / source size`` times: a whole
number of copies and a fraction. The fractions are rounded in pairs: words move at random from one
document to the other, expectations unchanged, until one of the two fractions is 0 or 1. So the words of a pair stay the same, and a whole
source misses its target only by the rounding of its last document.

The pairs form a reduction tree: a source's documents are dealt into blocks of about ``BLOCK_ROWS``, each block leaves one
document with a fraction, and these are the rows of the next level, ``FAN`` blocks to one, until a source has one left, which is rounded to the nearer side.
A source with a third of all documents is so many more blocks. Random numbers are hashes of the document, so reruns and retries agree.

Defined cases: a null text has size 0; documents of size 0 are taken 0 words. A null source is a source of its own, last in order. Rows alike in key,
text and source are one item in the rounding: as many of them as the item's rounded number are taken once more. An empty table gives an empty table; sources without words have target 0.
Other columns pass through ``mixed``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillbar.llm.frames import fresh, repeated, settled
from quillbar.llm.words import U64, mix, slices
from quillbar.operators.ordered import RowOrder

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK_ROWS = 8192
FAN = 1024
SEED = 20_240_601
CLOSE = 1e-9


def sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key, t, source, size``: words of every text; ``t`` is a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in slices(batch.column(2)):
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(3), rows.column(1), pa.array(texts.count.astype(np.int64))],
                    names=["key", "t", "source", "size"])
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(source).alias("source"), F.col(text).alias("text"), F.xxhash64(text, source).alias("t"))
    return rows.mapInArrow(run, "key long, t long, source string, size long")


def targets(by_source: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, a row for each source (one task holds all sources)."""
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("w", F.get(table, (F.col("rank") - 1) % len(weights))).withColumn("cap", F.col("source_size") * float(most))
    whole = Window.partitionBy()
    # sources reach their cap in order of cap / weight; the first one that does not sets the words for a unit of weight
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    tried = weighed.withColumn("unit", left / weight_left)
    first = F.min(F.when(F.col("unit") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "rank", "unit"))).over(whole)["unit"]
    # a source without words has cap 0 and so target 0
    target = F.least(F.col("cap"), F.coalesce(first, F.lit(0.0)) * F.col("w"))
    return tried.withColumn("target", target).select("source", "source_size", "target")


def pivot(chance: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int | None]:
    """Round chances in order, pair by pair. Returns the chances, all but at most one now 0 or 1, and the place of that one."""
    out = chance.astype(float).copy()
    held = None
    for j in range(len(out)):
        p, s = float(out[j]), float(size[j])
        if p <= CLOSE or p >= 1 - CLOSE:
            out[j] = round(p)
            continue
        if held is None:
            held = j
            continue
        q, r = float(out[held]), float(size[held])
        up = min(1 - q, p * s / r)
        down = min(q, (1 - p) * s / r)
        move = up if draw[j] * (up + down) < down else -down
        q, p = q + move, p - move * r / s
        for place, value in ((held, q), (j, p)):
            out[place] = round(value) if min(abs(value), abs(1 - value)) <= CLOSE else value
        held = next((x for x in (held, j) if 0 < out[x] < 1), None)
    return out, held


def _round(table: pa.Table) -> pa.Table:
    key = table["key"].fill_null(0).to_numpy().view(U64)
    named = mix(mix(key + U64(SEED)) ^ table["t"].to_numpy().view(U64))
    draw = (mix(named ^ U64(table["level"][0].as_py() + 1)) >> U64(11)).astype(float) / 2**53
    order = np.lexsort((table["t"].to_numpy(), named))
    chance, held = pivot(table["chance"].to_numpy()[order], table["mass"].to_numpy()[order], draw[order])
    open_row = np.zeros(len(order), dtype=bool)
    if held is not None:
        open_row[held] = True
    rows = table.take(pa.array(order))
    rows = rows.set_column(rows.schema.get_field_index("chance"), "chance", pa.array(chance))
    return rows.set_column(rows.schema.get_field_index("open"), "open", pa.array(open_row))


ITEM = "key long, t long, source string, mass long, chance double, block long, level int, open boolean"


def rounded(items: DataFrame, blocks: int, fan: int = FAN) -> DataFrame:
    """``key, t, source, mass, chance`` with every chance 0 or 1. ``items`` have ``key, t, source, mass, chance, block``; no source has more than ``blocks`` blocks."""
    level, done = 0, None
    rows = items.withColumns({"level": F.lit(0), "open": F.lit(False)})
    while True:
        rows = settled(rows.groupBy("source", "block").applyInArrow(_round, ITEM))
        closed = rows.where("not open")
        done = closed if done is None else done.unionByName(closed)
        if blocks <= 1:
            return done.unionByName(rows.where("open").withColumn("chance", F.round("chance"))).select("key", "t", "source", "mass", "chance")
        blocks, level = math.ceil(blocks / fan), level + 1
        rows = rows.where("open").withColumns({"block": F.floor(F.col("block") / fan), "level": F.lit(level)})


def plan(docs: DataFrame, key: str, text: str, source: str, block_rows: int) -> DataFrame:
    """``key, t, source, size, source_size, target, rows, base, extra``: of the ``rows`` rows alike in key, text and source each is taken ``base``
    times, and ``extra`` of them once more."""
    rows = sizes(docs, key, text, source)
    items = settled(rows.groupBy("key", "t", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    by_source = items.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"),
        F.greatest(F.ceil(F.count_if(F.col("size") > 0) / block_rows), F.lit(1)).alias("blocks"))
    by_source = settled(by_source)
    share = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    wanted = targets(by_source).withColumn("wanted", share).withColumnsRenamed({"source": "of", "source_size": "total"})
    wanted = settled(by_source.join(wanted, F.col("source").eqNullSafe(F.col("of"))).select("of", "source_size", "target", "wanted", "blocks"))
    most = wanted.agg(F.max("blocks")).first()[0] or 1
    # rows alike want a whole number of extra copies and a fraction, which is that of one row
    over = F.col("rows") * (F.col("wanted") - F.floor("wanted"))
    placed = items.join(wanted, F.col("source").eqNullSafe(F.col("of"))).withColumn("over", F.when(F.col("size") > 0, over).otherwise(0.0))
    cut = placed.where("size > 0").select(
        "key", "t", "source", F.col("size").alias("mass"), (F.col("over") - F.floor("over")).alias("chance"),
        F.pmod(F.xxhash64("key", "t"), F.col("blocks")).alias("block"))
    found = rounded(cut, int(most)).select(F.col("key").alias("k"), F.col("t").alias("u"), "chance")
    out = placed.join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("t") == F.col("u")), "left")
    base = F.when(F.col("size") > 0, F.floor("wanted")).otherwise(0)
    return out.select("key", "t", "source", "size", "source_size", "target", "rows", base.cast("int").alias("base"),
                      (F.floor("over") + F.coalesce("chance", F.lit(0))).cast("long").alias("extra"))


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``key, t, source, size, source_size, target, copies`` for every document."""
    rows = repeated(plan(docs, key, text, source, block_rows), "rows", "number")
    return rows.select("key", "t", "source", "size", "source_size", "target",
                       (F.col("base") + (F.col("number") <= F.col("extra")).cast("int")).alias("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The mix itself: each document as many times as it is taken (documents without words: not at all).

    Of rows alike in key, text and source the extra copies go to the first by a hash of all columns.
    """
    named, hashed, of, like, base, extra, row, rows, last, times, number = fresh(
        docs, "named", "hashed", "of", "like", "base", "extra", "row", "rows", "last", "times", "number")
    found = settled(plan(docs, key, text, source, block_rows).where("size > 0"))
    own = docs.withColumns({named: F.col(key).cast("long"), hashed: F.xxhash64(text, source)})
    split = (F.col("extra") > 0) & (F.col("extra") < F.col("rows"))

    def met(groups: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """The documents with columns of their item, and only documents that have one."""
        groups = groups.select(F.col("key").alias(of), F.col("t").alias(like), *[c.alias(name) for name, c in columns.items()])
        return own.join(groups, F.col(named).eqNullSafe(F.col(of)) & (F.col(hashed) == F.col(like)))

    whole = met(found.where(~split), {times: F.col("base") + (F.col("extra") > 0).cast("int")}).where(F.col(times) > 0)
    out = whole.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
    some = found.where(split)
    if some.isEmpty():
        return out
    # rows alike of which some are taken once more: rows equal in all columns are one, with their number, and have places by their hash
    parts = met(some, {base: F.col("base"), extra: F.col("extra")}).withColumn(row, F.xxhash64(*docs.columns))
    counts = settled(parts.groupBy(named, hashed, row, base, extra).agg(F.count(F.lit(1)).alias(rows)))
    counts = RowOrder((named, hashed), (row,)).running_sum(counts, {rows: last})
    more = F.least(F.greatest(F.col(extra) - (F.col(last) - F.col(rows)), F.lit(0)), F.col(rows))
    counts = counts.withColumn(times, F.col(base) * F.col(rows) + more).where(F.col(times) > 0)
    counts = counts.select(F.col(named).alias(of), F.col(hashed).alias(like), F.col(row).alias(number), times)
    same = F.col(named).eqNullSafe(F.col(of)) & (F.col(hashed) == F.col(like)) & (F.col(row) == F.col(number))
    rest = parts.drop(of, like).dropDuplicates([named, hashed, row]).join(counts, same).select(*docs.columns, times)
    return out.unionByName(repeated(rest, times, number).select(*docs.columns))
