"""Importance resampling towards a target distribution, on hashed word n-grams, with every distinct line looked at once.

Features are the runs of 1 to ``ngrams`` consecutive words of a text; the CRC-32 of a feature names one of ``buckets`` buckets. A bucket's gain
is the logarithm of how much more frequent it is in the target than in the source (integer thousandths, add-one smoothed); a
document's weight is the mean gain of its features. Gumbel noise from a hash of the document's id turns the highest scores into a draw
without replacement by these weights.

1. **Segments.** Newlines cut texts into lines, and equal lines of the whole table are one segment (a shuffle of the lines, aggregated before it).
   A segment is split into words and hashed once; its buckets are kept in the shared folder.
2. **Counts.** A segment's buckets times its occurrences, added up by task, then by bucket: ``buckets`` rows reach the driver at any size of the corpus.
3. **Crossing.** Runs that go over the end of a line depend on the document; they are hashed from the texts in a pass of their own, which
   one-word features do not need, and are added to both sides.
4. **Weights.** Each segment's gains are summed once. Documents meet their segments by two 64-bit hashes of the line; frequent segments are broadcast
   (``frames.meet``), and the sums by document are aggregated before the shuffle.
5. **Draw.** Scores are ordered in ranges of the whole table (``RowOrder``), so no task holds more than one range.

Defined cases: a null text has no words. A document without a feature has weight 0. A null key takes its random number from ``<seed>:`` alone and
comes last among ties. Repeated rows each count and each are drawn; rows of one key share the random number. Empty tables give empty
tables, an empty target gives gains for zero counts. Very long texts are read whole, line by line. Other columns pass through ``drawn``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillbar.llm.frames import HOT_ROWS, fresh, meet, repeated, settled
from quillbar.llm.words import byte_runs
from quillbar.operators.ordered import SMALLEST_SAMPLE, RowOrder

BUCKETS = 10_000
SEED = "2024"
PERCENT = 10
LEAST_WORDS = 20
LONG_WORD = 64
U32 = np.uint32

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[:0x80] = False
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True


def _crc_table() -> np.ndarray:
    state = np.arange(256, dtype=U32)
    for _ in range(8):
        state = (state >> U32(1)) ^ np.where(state & U32(1), U32(0xEDB88320), U32(0))
    return state


_CRC = _crc_table()


def crc_after(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 states (not inverted) after the bytes of each range, all ranges in step; long ranges one by one."""
    length = end - start
    out = state.copy()
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[start[i]:end[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = np.flatnonzero(length <= LONG_WORD)
    order = short[np.argsort(-length[short], kind="stable")]
    at, left, own = start[order], length[order], state[order]
    for j in range(int(left.max(initial=0))):
        open_ones = int(np.searchsorted(-left, -j, side="left"))
        some = own[:open_ones]
        own[:open_ones] = _CRC[(some ^ data[at[:open_ones] + j]) & U32(255)] ^ (some >> U32(8))
    out[order] = own
    return out


class Words:
    """The words of consecutive texts in one buffer, lower-cased: byte bounds and the number of the text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data = _FOLD[data]
        n = len(data)
        inside = _IN_WORD[self.data]
        cuts = bounds[(bounds > 0) & (bounds < n)]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.text = np.searchsorted(bounds, self.start, side="right") - 1

    def runs(self, ngrams: int, buckets: int, wanted=lambda first, last: True) -> tuple[np.ndarray, np.ndarray]:
        """Text and bucket of every run of 1 to ``ngrams`` words of one text for which ``wanted`` holds, in order of the texts."""
        state = np.full(len(self.start), 0xFFFFFFFF, dtype=U32)
        text, bucket = [], []
        for k in range(ngrams):
            m = len(self.start) - k
            if m <= 0:
                break
            if k:
                state = state[:m]
                state = _CRC[(state ^ U32(32)) & U32(255)] ^ (state >> U32(8))
            state = crc_after(state, self.data, self.start[k:], self.end[k:])
            first, last = np.arange(m), np.arange(k, m + k)
            ok = (self.text[first] == self.text[last]) & wanted(first, last)
            text.append(self.text[:m][ok])
            bucket.append((state[ok] ^ U32(0xFFFFFFFF)).astype(np.int64) % buckets)
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, bucket = np.concatenate(text), np.concatenate(bucket)
        order = np.argsort(text, kind="stable")
        return text[order], bucket[order]


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _lists(text: np.ndarray, bucket: np.ndarray, count: int, buckets: int) -> pa.Array:
    """The buckets of each text as the bytes of fixed-width numbers."""
    kind = np.dtype(_width(buckets))
    bounds = np.searchsorted(text, np.arange(count + 1)) * kind.itemsize
    return pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(bucket.astype(kind).tobytes())])


def lines(docs: DataFrame, text: str) -> DataFrame:
    """``k, t, first, line, a, b``: every line of every text, whether it is the first, and two hashes of it; needs ``k``."""
    cut = docs.select("k", F.xxhash64(text).alias("t"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("place", "line"))
    return cut.select("k", "t", (F.col("place") == 0).alias("first"), "line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"))


def segments(docs: DataFrame, text: str, ngrams: int, buckets: int) -> DataFrame:
    """``a, b, occurrences, words, found``: every distinct line once, with the buckets of its features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in byte_runs(batch.column(3)):
                here = Words(data, bounds)
                count = high - low
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(low, count).columns[:3], pa.array(np.bincount(here.text, minlength=count)), _lists(*here.runs(ngrams, buckets), count, buckets)],
                    names=["a", "b", "occurrences", "words", "found"])
    distinct = lines(docs.select(F.lit(0).alias("k"), text), text).groupBy("line", "a", "b").agg(F.count(F.lit(1)).alias("occurrences"))
    return distinct.select("a", "b", "occurrences", F.col("line").cast("binary")).mapInArrow(
        run, "a long, b long, occurrences long, words long, found binary")


def crossing(docs: DataFrame, text: str, ngrams: int, buckets: int) -> DataFrame:
    """``k, t, occurrences, found``: the buckets of each text's runs that go over the end of a line; needs ``k``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in byte_runs(batch.column(2)):
                here = Words(data, bounds)
                line = np.cumsum(data == 10)[here.start]
                found = here.runs(ngrams, buckets, lambda first, last: line[first] != line[last])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(low, high - low).columns[:2], pa.array(np.ones(high - low, dtype=np.int64)), _lists(*found, high - low, buckets)],
                    names=["k", "t", "occurrences", "found"])
    rows = docs.select("k", F.xxhash64(text).alias("t"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "k long, t long, occurrences long, found binary")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, from ``occurrences, found``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            lists = batch.column(1)
            values, sizes = _values(lists, buckets)
            total += np.bincount(values, weights=np.repeat(batch.column(0).to_numpy(), sizes), minlength=buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["bucket", "n"])
    rows = found.select("occurrences", "found").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def _values(lists: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column of lists, and how many each row has."""
    kind = np.dtype(_width(buckets))
    _, places, buffer = lists.buffers()
    bounds = np.frombuffer(places, dtype=np.int32)[lists.offset:lists.offset + len(lists) + 1]
    data = np.frombuffer(buffer, dtype=np.uint8)[bounds[0]:bounds[-1]] if buffer is not None else np.zeros(0, dtype=np.uint8)
    return data.view(kind).astype(np.int64), np.diff(bounds) // kind.itemsize


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target over source frequency, add-one smoothed, rounded down."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def _gained(found: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """The rows with ``n_features`` and the sum of their features' gains instead of ``found``."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = _values(batch.column(len(keep)), buckets)
            total = np.append(0, np.cumsum(gain[values]))
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes.astype(np.int64)), pa.array(total[ends] - total[ends - sizes])], names=[*keep, "n_features", "gain"])
    return found.select(*keep, "found").mapInArrow(run, ", ".join(f"{c} long" for c in [*keep, "n_features", "gain"]))


def _target_counts(target: DataFrame, text: str, ngrams: int, buckets: int) -> np.ndarray:
    named = target.select(F.lit(None).cast("long").alias("k"), text)
    out = bucket_counts(segments(named, text, ngrams, buckets), buckets)
    return out + bucket_counts(crossing(named, text, ngrams, buckets), buckets) if ngrams > 1 else out


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", ngrams: int = 1,
            buckets: int = BUCKETS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``k, t, copies, words, n_features, weight``: a row for every key and text (``t`` is a hash of the text), with the number of its rows."""
    named = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"))
    found = settled(segments(named, "text", ngrams, buckets))
    over = settled(crossing(named, "text", ngrams, buckets)) if ngrams > 1 else None
    source = bucket_counts(found, buckets)
    if over is not None:
        source = source + bucket_counts(over, buckets)
    gain = gains(source, _target_counts(target, target_text, ngrams, buckets))
    scored = settled(_gained(found, gain, ["a", "b", "occurrences", "words"]))
    places = settled(lines(named, "text").drop("line"))
    parts = meet(places, scored, ["a", "b"], "occurrences", hot_rows).select("k", "t", F.col("first").cast("long").alias("copies"), "words", "n_features", "gain")
    if over is not None:
        zero = F.lit(0).cast("long")
        parts = parts.unionByName(_gained(over, gain, ["k", "t"]).select(
            "k", "t", zero.alias("copies"), zero.alias("words"), "n_features", "gain"))
    summed = parts.groupBy("k", "t").agg(*[F.sum(c).alias(c) for c in ("copies", "words", "n_features", "gain")])
    each = summed.select("k", "t", "copies", *[F.expr(f"{c} div copies").alias(c) for c in ("words", "n_features", "gain")])
    return each.withColumn("weight", F.expr("if(n_features = 0, 0L, (gain - pmod(gain, n_features)) div n_features)")).drop("gain")


def noise(key: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths from the key alone, rounded down."""
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((number + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS,
           seed: str = SEED, smallest_sample: int = SMALLEST_SAMPLE, **options) -> DataFrame:
    """``key, t, number, n_features, weight, score, rank``: a row for each row of the table; ``rank`` counts the drawn ones from 1 and is
    null for all others. ``number`` tells rows repeated with key and text apart."""
    found = weights(docs, target, key, text, **options).withColumn("score", F.col("weight") + noise(F.col("k"), seed))
    rows = settled(repeated(found, "copies", "number").withColumns({"down": -F.col("score"), "none": F.col("k").isNull()}))
    able = rows.where(F.col("words") >= least_words)
    drawn = able.count() * percent // 100
    order = RowOrder((), ("down", "none", "k", "t", "number"), smallest_sample=smallest_sample)
    placed = order.positions(able, "place").withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    rest = rows.where(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(rest.columns).unionByName(rest).select(
        F.col("k").alias("key"), "t", "number", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that are drawn. Of rows repeated with key and text some may be left out; which of them is not defined."""
    taken = ranked(docs, target, key, text, **options).groupBy("key", "t").agg(F.count("rank").alias("taken"), F.count(F.lit(1)).alias("rows"))
    taken = settled(taken.where("taken > 0"))
    mark, hashed = fresh(docs, "drawn_key", "text_hash")
    named = docs.withColumn(hashed, F.xxhash64(text))
    match = F.col(key).cast("long").eqNullSafe(F.col(mark)) & (F.col(hashed) == F.col(hashed + "_"))
    names = [F.col("key").alias(mark), F.col("t").alias(hashed + "_")]
    whole = named.join(taken.where("taken = rows").select(names), match, "left_semi").select(docs.columns)
    for row in taken.where("taken < rows").collect():  # ranks are consecutive, so this is one key and text at most
        part = named.where(F.col(key).cast("long").eqNullSafe(F.lit(row["key"])) & (F.col(hashed) == F.lit(row["t"])))
        whole = whole.unionByName(part.limit(row["taken"]).select(docs.columns))
    return whole
