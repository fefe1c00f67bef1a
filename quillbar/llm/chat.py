"""Chat formatting after collapsing cumulative snapshots.

Chat logs often hold a conversation many times: after each turn, all turns so far. Every conversation gets a rolling hash of its turns,
one value for each prefix: the running XOR of position-keyed turn hashes, twice for 128 bits. A conversation whose last value
is a proper prefix value of another one is a snapshot of it. Snapshots go by anti-join, equal conversations leave the one with the smallest id, and what remains is rendered.

Everything is DataFrame functions. Prefix values are made distinct before the join, so a first turn or a conversation that a third
of the log repeats is one row for each task there. The turns of one conversation end in one row, as its rendering does, and so
meet in one task; nothing else is collected.

Defined cases: null roles and texts count as empty. Turns are ordered by number (null first), role and text; rows alike in all four columns are one turn. Rows without an id form a
conversation of their own. Rolling hashes look at roles and texts, not at turn numbers. An empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
"""Fixed marks of the widely used chat markup."""


def turns(log: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, pos, role, text, n, one, two``: distinct turns in order, with the rolling hashes of the prefix that ends there."""
    rows = log.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                      F.coalesce(text, F.lit("")).alias("text")).distinct()
    ordered = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("pos", F.row_number().over(ordered))
    upto = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def rolling(seed: int) -> Column:
        return F.bit_xor(F.xxhash64(F.lit(seed), "pos", "role", "text")).over(upto)

    return placed.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("conv")), "one": rolling(1), "two": rolling(2)})


def maximal(hashed: DataFrame) -> DataFrame:
    """``conv`` of the conversations that no other one continues, one of each set of equals."""
    whole = hashed.where("pos = n").groupBy("n", "one", "two").agg(
        F.min(F.struct(F.col("conv").isNull().alias("none"), "conv"))["conv"].alias("conv"))
    prefixes = hashed.where("pos < n").select(F.col("pos").cast("long").alias("n"), "one", "two").distinct()
    return whole.join(prefixes, ["n", "one", "two"], "left_anti").select("conv")


def rendered(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             begin: str = BEGIN, middle: str = MIDDLE, end: str = END) -> DataFrame:
    """``conv, n_turns, text``: every maximal conversation as one string. Marks inside a text are broken up, so that no text can open or close a turn."""
    hashed = turns(log, conv, turn, role, text)
    kept = maximal(hashed).withColumnRenamed("conv", "kept")
    chosen = hashed.select("conv", "pos", "role", "text").join(kept, F.col("conv").eqNullSafe(F.col("kept")), "left_semi")
    safe = F.replace("text", F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit(begin), "role", F.lit(middle), safe, F.lit(end))
    return (
        chosen.select("conv", F.struct("pos", line.alias("line")).alias("turn"))
        .groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list("turn")).alias("all"))
        .select("conv", "n_turns", F.array_join(F.transform("all", lambda t: t["line"]), "").alias("text"))
    )
