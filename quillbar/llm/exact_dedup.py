"""Exact deduplication by composable polynomial fingerprints.

Texts are equal when their UTF-8 bytes are, after lower-casing A-Z. With the bytes ``b[0], b[1], ...`` of a text its
fingerprint is its length and, for two prime moduli, ``sum((b[i] + 1) * base**i)``.

1. **Chunks.** A text is hashed in chunks of ``CHUNK`` bytes, all chunks of a batch at once. The hash of a text follows from those of its chunks by
   shifting each by the bytes before it: ``hash(x + y) = hash(x) + base**len(x) * hash(y)`` (``joined_hash``). So a text above
   ``split_bytes`` need not be hashed by one task: it is cut into pieces, the pieces are dealt to all tasks, each shifts its own hash,
   and a sum over the pieces gives the fingerprint.
2. **Groups.** Fingerprints are counted, aggregated before the shuffle.
3. **Comparison.** Rows whose fingerprint is not alone are read again and compared chunk by chunk: in a batch each chunk with the one
   that the first text of this fingerprint has there, then across batches as a grouping by fingerprint, place and chunk, again aggregated
   before the shuffle. One group of any size costs a chunk or so for each task and place.
4. **Collisions.** Where a place has more than one chunk under one fingerprint, the group is cut by which chunks its texts have there.

Fingerprints, counts and groups stay distributed. A group that holds a large part of all rows is broadcast to them (``frames.meet``), rows
repeated with key and text are counted and not gathered.

Defined cases: a null text counts as empty, and empty texts are equal. A null key counts as the smallest; a group of null keys only has a null ``keep_id``.
Of rows that tie for the largest key one stays: that with the larger hash of its text, and one of the rows repeated as a whole. An
empty table gives an empty table; columns with names that are used here pass through ``deduplicated``. Very long texts are hashed and
compared in chunks; the digest alone reads them as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillbar.llm.frames import HOT_ROWS, fresh, meet, repeated, settled, width
from quillbar.llm.words import U64, byte_runs

CHUNK = 1 << 16
SPLIT_BYTES = 8 << 20
"""A longer text is hashed by several tasks."""
MODULI = (2**31 - 1, 2**31 - 19)
BASES = (1_172_839_049, 1_893_246_611)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRINT = ["n", "h1", "h2"]


def joined_hash(left: tuple[int, int, int], right: tuple[int, int, int], moduli: tuple[int, int] = MODULI) -> tuple[int, int, int]:
    """The fingerprint of two texts one after the other, from theirs."""
    n = left[0]
    return (n + right[0], *((a + pow(base, n, p) * b) % p for a, b, base, p in zip(left[1:], right[1:], BASES, moduli)))


def _chunks_of(bounds: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place within the text and first byte of every chunk."""
    counts = -(-np.diff(bounds) // chunk)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, place, bounds[text] + place * chunk


def polynomial(data: np.ndarray, bounds: np.ndarray, which: int, modulus: int, chunk: int = CHUNK) -> np.ndarray:
    """The hash of every text: its chunks' hashes, each shifted by the bytes before it, and added up."""
    out = np.zeros(len(bounds) - 1, dtype=U64)
    text, place, first = _chunks_of(bounds, chunk)
    if not len(text):
        return out
    longest = int(min(chunk, np.diff(bounds).max()))
    power = np.array(_powers(which, modulus, longest), dtype=U64)
    within = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    own = np.add.reduceat((data.astype(U64) + U64(1)) * power[within], first) % U64(modulus)
    step = pow(BASES[which], chunk, modulus)
    shifts = [1]
    for _ in range(int(place.max())):
        shifts.append(shifts[-1] * step % modulus)
    np.add.at(out, text, own * np.array(shifts, dtype=U64)[place] % U64(modulus))
    return out % U64(modulus)


_known_powers: dict[tuple[int, int], list[int]] = {}


def _powers(which: int, modulus: int, count: int) -> list[int]:
    """The first powers of a base, kept for the next batch."""
    have = _known_powers.setdefault((which, modulus), [1])
    while len(have) < count:
        have.append(have[-1] * BASES[which] % modulus)
    return have[:count]


def normal(text: str) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``k, t, text``: the key, a hash of the text as it stands (``k, t`` name a text when it is read again), the lower-cased bytes."""
    return docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("t"), normal(text).alias("text"))


def _hashed(rows: DataFrame, chunk: int, moduli: tuple[int, int]) -> DataFrame:
    """``k, t, sha, start, n, h1, h2`` from ``k, t, sha, start, text``; hashes are shifted by ``start`` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(3).to_numpy()
            for low, high, data, bounds in byte_runs(batch.column(4)):
                here = starts[low:high]
                hashes = []
                for which, modulus in enumerate(moduli):
                    own = polynomial(data, bounds, which, modulus, chunk)
                    for i in np.flatnonzero(here):
                        own[i] = int(own[i]) * pow(BASES[which], int(here[i]), modulus) % modulus
                    hashes.append(pa.array(own.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(low, high - low).columns[:4], pa.array(np.diff(bounds)), *hashes], names=["k", "t", "sha", "start", *PRINT])
    return rows.mapInArrow(run, "k long, t long, sha string, start long, n long, h1 long, h2 long")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = True, split_bytes: int = SPLIT_BYTES,
                 chunk: int = CHUNK, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """``k, t, sha, n, h1, h2, copies``: a row for every key and text, with the number of its rows."""
    piece = max(split_bytes // chunk, 1) * chunk
    named = _named(docs, key, text).withColumn("sha", F.sha2("text", 256) if digest else F.lit(""))
    short = F.octet_length("text") <= split_bytes
    whole = named.where(short).select("k", "t", "sha", F.lit(0).cast("long").alias("start"), F.col("text").cast("binary").alias("text"))
    own = ["k", "t", "sha"]
    one_task = _hashed(whole, chunk, moduli).groupBy(*own, *PRINT).agg(F.count(F.lit(1)).alias("copies"))
    pieces = F.expr(f"transform(sequence(0L, cast(octet_length(text) as bigint) - 1, {piece}L), "
                    f"x -> struct(x as start, substring(cast(text as binary), cast(x + 1 as int), {piece}) as text))")
    cut = named.where(~short).select(*own, F.explode(pieces).alias("piece")).select(*own, "piece.*")
    dealt = _hashed(cut.repartition(width(docs.sparkSession), "k", "t", "start"), chunk, moduli)
    by_piece = dealt.groupBy(*own, "start", *PRINT).agg(F.count(F.lit(1)).alias("copies"))
    many_tasks = by_piece.groupBy(*own).agg(
        F.sum("n").alias("n"), *[(F.sum(h) % p).alias(h) for h, p in zip(PRINT[1:], moduli)], F.max("copies").alias("copies"))
    return one_task.unionByName(many_tasks)


def _grouped(rows: DataFrame, by: list[str], hot_rows: int) -> DataFrame:
    """The rows with their group: ``members`` (keys and texts), ``group_size`` (rows) and ``head``, the key and text that stay."""
    groups = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("members"), F.sum("copies").alias("group_size"),
        F.max(F.struct(F.col("k").isNotNull().alias("some"), "k", "t")).alias("head"))
    return settled(meet(rows, settled(groups), by, "members", hot_rows))


def _compared(texts: DataFrame, chunk: int, named: bool) -> DataFrame:
    """The chunks of ``k, t, n, h1, h2, text``: ``n, h1, h2, place, chunk``, within a batch only those that differ from the first text
    of their fingerprint (and its own); with ``named`` all of them, with ``k, t``."""
    own = ["k", "t"] if named else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = list(zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]))
            names = [batch.column(i) for i in range(len(own))]
            for low, high, data, bounds in byte_runs(batch.column(5)):
                raw = memoryview(data)
                text, place, first = _chunks_of(bounds, chunk)
                last = np.minimum(first + chunk, bounds[text + 1])
                seen: dict[tuple, memoryview] = {}
                kept = []
                for i, (d, at, a, b) in enumerate(zip(text.tolist(), place.tolist(), first.tolist(), last.tolist())):
                    part = raw[a:b]
                    if named or seen.setdefault((*prints[low + d], at), part) is part or seen[(*prints[low + d], at)] != part:
                        kept.append(i)
                rows = low + text[kept]
                print_of = np.array([prints[r] for r in rows.tolist()], dtype=np.int64).reshape(-1, 3)
                parts = [bytes(raw[a:b]) for a, b in zip(first[kept].tolist(), last[kept].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(rows)) for c in names], *[pa.array(print_of[:, i]) for i in range(3)],
                     pa.array(place[kept].astype(np.int64)), pa.array(parts, pa.binary())], names=[*own, *PRINT, "place", "chunk"])
    kind = "n long, h1 long, h2 long, place long, chunk binary"
    return texts.select("k", "t", *PRINT, F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "k long, t long, " + kind if named else kind)


def _read_again(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """``k, t, n, h1, h2, text`` of the rows named by ``k, t``."""
    names = wanted.select(F.col("k").alias("wk"), F.col("t").alias("wt"), *PRINT)
    return _named(docs, key, text).join(names, F.col("k").eqNullSafe(F.col("wk")) & (F.col("t") == F.col("wt"))).drop("wk", "wt")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = True, split_bytes: int = SPLIT_BYTES, chunk: int = CHUNK,
            moduli: tuple[int, int] = MODULI, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``k, t, sha, copies, group_size, head, ...``: every key and text with its group of equal texts."""
    rows = settled(fingerprints(docs, key, text, digest, split_bytes, chunk, moduli))
    found = _grouped(rows, PRINT, hot_rows)
    texts = _read_again(docs, key, text, found.where("members > 1"))
    at = [*PRINT, "place"]
    variants = _compared(texts, chunk, named=False).distinct()
    clashes = settled(variants.groupBy(*at).agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select(at))
    if clashes.isEmpty():
        return found
    apart = found.join(clashes.select(PRINT).distinct(), PRINT, "left_semi")
    parts = settled(_compared(_read_again(docs, key, text, apart), chunk, named=True).join(clashes, at, "left_semi").distinct())
    numbers = parts.select(*at, "chunk").distinct().withColumn("number", F.row_number().over(Window.partitionBy(at).orderBy("chunk")))
    vector = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "number"))),
                                      lambda x: F.concat_ws(":", x["place"], x["number"])), ",")
    which = parts.join(numbers, [*at, "chunk"]).groupBy(F.col("k").alias("wk"), F.col("t").alias("wt")).agg(vector.alias("which"))
    same = F.col("k").eqNullSafe(F.col("wk")) & (F.col("t") == F.col("wt"))
    cut = rows.join(which, same, "left").withColumn("which", F.coalesce("which", F.lit(""))).drop("wk", "wt")
    return _grouped(settled(cut), [*PRINT, "which"], hot_rows)


_STAYS = "k <=> head.k and t = head.t"


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256``: a row for each row of the table; the digest is that of the lower-cased text."""
    found = classes(docs, key, text, **options).select(
        F.col("k").alias("key"), F.col("head.k").alias("keep_id"), "group_size", F.expr(_STAYS).alias("stays"), F.col("sha").alias("text_sha256"), "copies")
    return repeated(found, "copies", "number").select(
        "key", "keep_id", "group_size", (F.col("stays") & (F.col("number") == 1)).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay, one for each text."""
    mark, hashed, many = fresh(docs, "staying_key", "text_hash", "copies")
    stay = classes(docs, key, text, digest=False, **options).where(_STAYS).select(
        F.col("k").alias(mark), F.col("t").alias(hashed + "_"), F.col("copies").alias(many))
    named = docs.withColumn(hashed, F.xxhash64(text))
    met = named.join(stay, F.col(key).cast("long").eqNullSafe(F.col(mark)) & (F.col(hashed) == F.col(hashed + "_")))
    comparable = [f.name for f in docs.schema if "map" not in f.dataType.simpleString()]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # of rows repeated with key and text, which may differ in other columns, the one with the smallest hash
    one = met.where(F.col(many) > 1).groupBy(mark, hashed).agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in comparable])).alias("row"))
    return met.where(F.col(many) == 1).select(docs.columns).unionByName(one.select("row.*"))
