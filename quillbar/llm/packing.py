"""Best-fit packing of token sequences into rows of fixed length.

Documents become ids, with an end id after each, and only what is longer than a sequence is cut. Pieces are dealt into groups by hash,
about ``GROUP_PIECES`` a group, and each group is packed by bounded-space best fit: at most ``OPEN`` open bins, held in a bitset keyed by free space. A piece goes into
the open bin with the least free space that holds it, found by shifting the bitset; if none does, a new bin opens, and where that is one too
many, the fullest closes first. Pieces arrive longest first within a group, which is what fills the gaps: on the test tables the sequences are
within 0.1 % of tokens / capacity, against 0.9 % in hash order. A group wastes at most its last open bins, whatever the table's size.

Only lengths travel; ``sequences`` moves the ids themselves, once, to their place.

Defined cases: a null or empty text is its end id alone. Repeated rows are packed each by itself. An empty table gives an empty table.
Other columns of the table are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillbar.llm.frames import settled, width
from quillbar.llm.tokens import Encoder
from quillbar.llm.words import slices

CAPACITY = 2048
OPEN = 8192
GROUP_PIECES = 16_384
END = 0
VOCABULARY = "word_bpe_49k.json"


class OpenBins:
    """At most ``most`` open bins. ``mask`` has bit f set if a bin with free space f is open."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.mask, self.open, self.next = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        at = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        self.open -= 1
        return at

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it that a piece of 1 to ``capacity`` tokens gets."""
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.capacity, self.next
            self.next += 1
            if length < free and self.open >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.mask |= 1 << left
            self.open += 1
        return at, self.capacity - free


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END,
           capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``key, piece, start, length, ids_crc32, salt`` (and ``ids``, little-endian 32-bit), a row for each piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(vocabulary)
        for batch in batches:
            for low, high, texts in slices(batch.column(1)):
                ids, bounds = encoder.encode(texts, end)
                count = -(-np.diff(bounds) // capacity)
                doc = np.repeat(np.arange(high - low), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                begin = bounds[doc] + piece * capacity
                stop = np.minimum(begin + capacity, bounds[doc + 1])
                raw = ids.astype("<u4").view(np.uint8).data
                parts = [raw[4 * a:4 * b] for a, b in zip(begin.tolist(), stop.tolist())]
                columns = [
                    batch.column(0).slice(low, high - low).cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                    pa.array(piece * capacity), pa.array(stop - begin), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    batch.column(2).slice(low, high - low).take(pa.array(doc))]
                names = ["key", "piece", "start", "length", "ids_crc32", "salt"]
                if with_ids:
                    columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "key long, piece int, start long, length long, ids_crc32 long, salt long" + (", ids binary" if with_ids else "")
    # rows without a key are told apart by their text
    salt = F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.xxhash64(text))
    return docs.select(key, text, salt.alias("salt")).mapInArrow(run, schema)


def packed(cut: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces. Reads the pieces twice, so give it a settled table."""
    groups = max(1, math.ceil(cut.count() / group_pieces))
    if groups > 1:
        groups = max(groups, min(width(cut.sparkSession), 2 * groups))
    names = [c for c in cut.columns if c != "salt"]

    def run(group: tuple, table: pa.Table) -> pa.Table:
        base = group[0].as_py() << 40
        order = np.lexsort((table["ids_crc32"].to_numpy(), table["piece"].to_numpy(), table["salt"].to_numpy(), -table["length"].to_numpy()))
        bins = OpenBins(capacity, most_open)
        placed = np.array([bins.put(n) for n in table["length"].to_numpy()[order].tolist()], dtype=np.int64).reshape(-1, 2)
        rows = table.select(names).take(pa.array(order))
        return rows.append_column("sequence_id", pa.array(placed[:, 0] + base)).append_column("offset", pa.array(placed[:, 1]))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "salt")
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("salt", "piece"), F.lit(groups)).cast("int"))
    return dealt.groupBy("group").applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END,
         capacity: int = CAPACITY) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document."""
    return packed(settled(pieces(docs, key, text, vocabulary, end, capacity)), capacity)


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END,
              capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, length, ids, parts``: the packed sequences themselves, ids as little-endian 32-bit, ``parts`` saying whose they are."""
    rows = packed(settled(pieces(docs, key, text, vocabulary, end, capacity, with_ids=True)), capacity)
    part = F.struct("offset", "length", "key", "piece", "ids")
    return (
        rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(part)).alias("p"))
        .select("sequence_id", "length",
                F.aggregate("p", F.lit(b"").cast("binary"), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"),
                F.transform("p", lambda p: F.struct(p["offset"], p["length"], p["key"], p["piece"])).alias("parts"))
    )
