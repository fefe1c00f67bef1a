"""N-gram Jaccard self-join with an R-tree over count vectors.

A document is the set of its distinct word shingles. Two documents link when ``100 * intersection >= percent * union``.
The join is exact and goes from sets to points to pairs:

1. **Cells.** Documents that link are never compared across cells. Two sets of similarity ``t`` differ in at most
   ``D = (1 - t) / t * n`` shingles. The hash space is cut into ``M`` equal segments, ``M`` a power of two so that a segment has about 2 to 5 shingles (fewer for a lower ``percent``); a
   set's part of a segment is one key. A differing shingle spoils one key, so linked sets have a key in common among the first
   ``D + 1`` keys of either, in any order that is the same for all sets. Rare keys come first, by a sketch of all keys of fixed size, so
   that what many documents share (a license, a common line) ties no unrelated ones together. Sets of up to ``SINGLES`` shingles take single shingles as keys. A size near
   a power of two emits for the lower one, too. Documents with a common key, directly or through others, form a cell.
2. **Points.** Within a cell, shingles are hashed into ``GROUPS`` groups, more where its sets are large. A set becomes the vector of its group counts, and the vectors
   go into an R-tree packed by size and widest coordinate. The overlap of two sets is at most the sum of the
   coordinate minima; against the upper corner of a box this bounds a whole subtree.
3. **Pairs.** What the bound leaves is verified on the sets themselves. Pairs already joined through others are not
   verified again, so a cell of near copies costs about one verification for each document.

Equal sets are one class and are joined once. Keys are pre-aggregated by batch of documents, so a key of a third of all documents is a row for
each batch. In a cell above ``CELL`` classes or ``VALUES`` shingles most classes share no key with most others. Its points alone are joined first, key by key (keys of
the same classes once), as linked sets have a key in common: the work follows the pairs that share a key and not the square of the cell. Where the keys have
more pairs than the cell, as in a cell of near copies, the cell itself is joined. What ties there are the new, smaller cells. A key or cell that is still large
is cut into blocks by size, and block pairs whose sizes can link are joined in tasks of their own, in bounded memory.

Shingles are compared by 64-bit hashes. That the D + 1 keys exist fails only where more segments of a set are empty than its size allows: for 65 shingles 21 of 32 (4 are to be expected; chance
below 1e-9), for 400 shingles 58 of 128 (6 expected; below 1e-30). At 80 percent segments are smaller: for 120 shingles 34 of 64 (10 expected), for 878
shingles 37 of 256 (8 expected).

Defined cases: a null or word-less text has the empty set and links with nothing. A text with fewer words than a shingle is one shingle of all its
words. Repeated rows are copies like any other. A null key links like any other document but is the smallest key only of a component
of null keys. An empty table gives an empty table. Other columns pass through ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from quillbar.llm.components import components, stars
from quillbar.llm.frames import fresh, meet, settled, width
from quillbar.llm.words import U64, Texts, mix, signed, slices, windows
from quillbar.operators.ordered import RowOrder

SHINGLE = 4
PERCENT = 85
SINGLES = 64
LOADS = np.append(np.full(7, 3.0), [4.5, 5.0])
"""The most shingles a segment has on average, by the number of bits that name it (the last for all above), at 85 percent."""
GROUPS = 64
MOST_GROUPS = 1024
LEAF = 32
CELL = 1024
VALUES = 1 << 21
"""A block holds at most ``CELL`` sets and about this many shingles (one larger set is a block of its own)."""
WINDOW_ROWS = 1 << 20
"""Classes of a cell are numbered by a plain window up to so many rows (about 60 MB) in all, in ranges beyond."""
SKETCH = 20
SIEVE = 27
"""The most bits that say which keys are wanted are two to this power."""
KEYED = 8192
"""Rows of a class and a key of it that a task compares at once, on average."""
FAR = np.iinfo(np.int64).max
WORD = "[^\\x09-\\x0D ]"
"""What every text with a word has."""


class Sets:
    """The distinct shingle hashes of consecutive texts, sorted within each text."""

    def __init__(self, texts: Texts, size: int):
        n = len(texts.offsets) - 1
        words = texts.hashes(lower=True)
        ok = texts.inside(size)
        m = len(ok)
        hashes, doc = windows(words, size)[ok], texts.doc[:m][ok]
        short = np.flatnonzero((texts.count > 0) & (texts.count < size))
        if len(short):
            whole = [mix(np.array([k], dtype=U64) ^ windows(words[texts.first[d]:texts.first[d] + k], k))[0]
                     for d, k in zip(short.tolist(), texts.count[short].tolist())]
            hashes, doc = np.append(hashes, np.array(whole, dtype=U64)), np.append(doc, short)
        order = np.argsort(hashes)
        hashes, doc = hashes[order], doc[order]
        order = np.argsort(doc.astype(np.uint16) if n < 1 << 16 else doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        self.hash, self.doc = hashes[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        self.size = np.diff(self.first)

    def sums(self, values: np.ndarray) -> np.ndarray:
        run = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values, out=run[1:])
        return run[self.first[1:]] - run[self.first[:-1]]

    def identity(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each set."""
        salt = mix(self.size.astype(U64))
        return mix(self.sums(mix(self.hash)) ^ salt), mix(self.sums(mix(self.hash ^ U64(0xA0761D6478BD642F))) + salt)


def _differ_most(size: np.ndarray, percent: int, larger_only: bool) -> np.ndarray:
    """How many shingles two linked sets may differ in, seen from a set of this size."""
    return 2 * size * (100 - percent) // (100 + percent) if larger_only else size * (100 - percent) // percent


def _largest(percent: int) -> np.ndarray:
    """The largest set of each level, so that its filled segments outnumber the shingles that linked sets may differ in as they do at 85 percent."""
    bits = np.arange(48)
    load = LOADS[np.minimum(bits, len(LOADS) - 1)]
    tried = np.arange(1, 801) / 100
    filled = lambda x: -np.expm1(-x) / x
    need = filled(load) * (85 / 15) * ((100 - percent) / percent)
    load = tried[np.maximum((filled(tried) >= need[:, None] - 1e-9).sum(axis=1) - 1, 0)]
    return np.floor(load * 2.0 ** bits + 1e-6).astype(np.int64)


def _level(size: np.ndarray, percent: int) -> np.ndarray:
    """The number of bits that name a segment; 0 for single shingles. It never falls with the size."""
    return np.where(size <= SINGLES, 0, np.maximum(np.searchsorted(_largest(percent), size), 1))


def all_keys(sets: Sets, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The keys of each set on its own level, and on the lower one where that is another: key, number of the text, whether lower."""
    smallest = -(-sets.size * percent // 100)
    own, lower = _level(sets.size, percent), _level(smallest, percent)
    for level, wanted, larger_only in ((own, sets.size > 0, False), (lower, lower != own, True)):
        take = wanted[sets.doc]
        hashes, doc = sets.hash[take], sets.doc[take]
        if not len(doc):
            continue
        bits = level[doc].astype(U64)
        part = np.where(bits == 0, hashes, hashes >> ((U64(64) - bits) & U64(63)))
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        yield mix(np.add.reduceat(mix(hashes), at) ^ mix(part[at] + (bits[at] << U64(48)) + U64(5))), doc[at], larger_only


def _counter(keys: np.ndarray) -> np.ndarray:
    return (keys >> U64(64 - SKETCH)).astype(np.int64)


def frequent_keys(docs: DataFrame, text: str, shingle: int, percent: int) -> np.ndarray:
    """For each of ``2 ** SKETCH`` counters, how far the number of keys that hash to it is above the average, in quarters of a power of two.

    All keys of all documents are counted. Tasks add up their own counters, then counters are added across tasks; what reaches the driver has that fixed size.
    """
    run_length = 1 << 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH, dtype=np.int64)
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                for keys, _, _ in all_keys(Sets(texts, shingle), percent):
                    total += np.bincount(_counter(keys), minlength=1 << SKETCH)
        parts = total.reshape(-1, run_length)
        used = np.flatnonzero(parts.any(axis=1))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(parts[used].ravel()), run_length).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), lists], names=["part", "counts"])

    def add(group: tuple, table: pa.Table) -> pa.Table:
        total = table["counts"].combine_chunks().flatten().to_numpy().reshape(-1, run_length).sum(axis=0)
        return pa.table({"part": pa.array([group[0].as_py()], pa.int32()), "counts": pa.array([total], pa.list_(pa.int64()))})

    schema = "part int, counts array<long>"
    total = np.zeros(1 << SKETCH, dtype=np.int64)
    found = docs.select(text).mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).toArrow()
    for part, counts in zip(found["part"].to_pylist(), found["counts"]):
        total[part * run_length:(part + 1) * run_length] = counts.values.to_numpy()
    return np.minimum(4 * np.log2(1 + total / max(total.mean(), 1.0)), 127).astype(np.uint8)


def cell_keys(sets: Sets, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first keys of each set, rare ones first: key and number of the text."""
    out = []
    for keys, doc, larger_only in all_keys(sets, percent):
        # frequency class in the top bits, then the key's own hash: one order for all sets
        order = np.argsort((frequent[_counter(keys)].astype(U64) << U64(57)) | (mix(keys) >> U64(7)))
        order = order[np.argsort(doc[order].astype(np.uint16) if len(sets.size) < 1 << 16 else doc[order], kind="stable")]
        keys, doc = keys[order], doc[order]
        rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(sets.size)))[doc]
        few = rank <= _differ_most(sets.size, percent, larger_only)[doc]
        out.append((keys[few], doc[few]))
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate([k for k, _ in out]), np.concatenate([d for _, d in out])


def signatures(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``key`` and the class of each document: two hashes of its set, and the set's size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in slices(batch.column(batch.schema.get_field_index(text))):
                sets = Sets(texts, shingle)
                one, two = sets.identity()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(key)).slice(low, high - low).cast(pa.int64()), batch.column(batch.schema.get_field_index("_t")).slice(low, high - low),
                     pa.array(signed(one)), pa.array(signed(two)), pa.array(sets.size.astype(np.int64))],
                    names=["key", "t", "a", "b", "n"])
    return docs.select(key, text, F.xxhash64(text).alias("_t")).mapInArrow(run, "key long, t long, a long, b long, n long")


def key_groups(docs: DataFrame, text: str, shingle: int, percent: int, frequent: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Links ``a, head`` of classes that share a key, and ``k, head`` for the keys of two or more classes (of keys that the same classes share, one)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                sets = Sets(texts, shingle)
                keys, doc = cell_keys(sets, percent, frequent)
                names = sets.identity()[0][doc]
                order = np.lexsort((names, keys))
                keys, names = keys[order], names[order]
                other = np.ones(len(keys), dtype=bool)
                other[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])
                keys, names = keys[other], names[other]
                new = np.ones(len(keys), dtype=bool)
                new[1:] = keys[1:] != keys[:-1]
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(keys)))
                head = np.repeat(names[first], many)
                # within the batch one class speaks for a key; the others are tied to it by a key of the two alone
                tied = np.unique(np.stack([names[names != head], head[names != head]]), axis=1)
                tie = mix(tied[0] ^ mix(tied[1]))
                # what tells the classes of a key apart from those of another: their number and two sums of their names' halves
                ties = np.zeros(2 * len(tie), dtype=np.int64)
                half = [np.add.reduceat(x, first) if len(first) else ties for x in (signed(names) >> 32, (names & U64(0xFFFFFFFF)).astype(np.int64))]
                alone = np.append(many == 1, np.zeros(len(ties), dtype=bool))
                sums = pa.StructArray.from_arrays([pa.array(np.append(x, ties)) for x in (many, *half)], names=["m", "high", "low"], mask=pa.array(alone))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate([keys[first], tie, tie]))),
                     pa.array(signed(np.concatenate([names[first], tied[0], tied[1]]))), sums], names=["k", "a", "sums"])
    # dealt by key before the window's own columns are made, so that these do not move
    listed = docs.select(text).mapInArrow(run, "k long, a long, sums struct<m:long,high:long,low:long>").repartition("k")
    same = Window.partitionBy("k")
    many = F.coalesce("sums.m", F.lit(1))
    met = listed.withColumns({
        "head": F.min("a").over(same), "last": F.max("a").over(same), "most": F.max(many).over(same), "m": F.sum(many).over(same),
        "high": F.sum(F.coalesce("sums.high", F.shiftright("a", 32))).over(same),
        "low": F.sum(F.coalesce("sums.low", F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)))).over(same)})
    # a row that is not the head is a link, one that is stands for its key; the keys of ties have no classes of their own
    met = met.where("head <> last or most > 1").where("a <> head or m > 1")
    link = F.col("a") != F.col("head")
    found = settled(met.select(
        F.when(link, F.col("a")).otherwise(F.col("high")).alias("x"), F.when(link, F.col("head")).otherwise(F.col("low")).alias("y"),
        F.when(link, 0).otherwise(F.col("m")).alias("m"), "k", "head").groupBy("x", "y", "m").agg(F.min("k").alias("k"), F.min("head").alias("head")))
    return found.where("m = 0").select(F.col("x").alias("a"), "head"), found.where("m > 0").select("k", "head")


def cells(links: DataFrame) -> DataFrame:
    """``a, cell`` of every class that shares a key with another; ``a`` is the first class hash (classes that share it share a cell)."""
    return components(links, "a", "head").select(F.col("node").alias("a"), F.col("root").alias("cell"))


def shingle_sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """The rows with the text replaced by ``a, b, n, set``: its class, and its shingle hashes."""
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in slices(batch.column(0)):
                sets = Sets(texts, shingle)
                one, two = sets.identity()
                lists = pa.ListArray.from_arrays(pa.array(sets.first.astype(np.int32)), pa.array(signed(sets.hash)))
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[1:], pa.array(signed(one)), pa.array(signed(two)), pa.array(sets.size.astype(np.int64)), lists],
                    names=[*others, "a", "b", "n", "set"])
    kinds = StructType([docs.schema[c] for c in others]).add("a", "long").add("b", "long").add("n", "long").add("set", ArrayType(LongType()))
    return docs.select(text, *others).mapInArrow(run, kinds)


class RTree:
    """Points packed into boxes of LEAF, boxes into boxes of LEAF, up to the root."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        widest = int(np.argmax(points.max(axis=0).astype(np.int64) - points.min(axis=0))) if len(points) else 0
        slab = max(1, int(np.sqrt(len(points) / LEAF))) * LEAF
        by_size = np.argsort(sizes, kind="stable")
        self.order = np.concatenate([part[np.argsort(points[part, widest], kind="stable")]
                                     for part in np.split(by_size, range(slab, len(points), slab))]) if len(points) else by_size
        upper, smallest, largest = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = []
        while True:
            at = np.arange(0, len(upper), LEAF)
            upper, smallest, largest = np.maximum.reduceat(upper, at), np.minimum.reduceat(smallest, at), np.maximum.reduceat(largest, at)
            self.levels.append((upper, smallest, largest))
            if len(upper) == 1:
                break

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose box may hold a partner of the set."""
        boxes = np.array([0])
        for upper, smallest, largest in reversed(self.levels):
            boxes = boxes[boxes < len(upper)]
            bound = np.minimum(upper[boxes], point).sum(axis=1)
            need = (percent * (size + smallest[boxes]) + percent + 99) // (100 + percent)
            open_box = (bound >= need) & (100 * largest[boxes] >= percent * size) & (100 * size >= percent * smallest[boxes])
            boxes = (boxes[open_box][:, None] * LEAF + np.arange(LEAF)).ravel()
        return self.order[boxes[boxes < len(self.order)]]


def groups_for(largest: int) -> int:
    """Unrelated sets of n shingles have group counts that differ by about sqrt(n * groups) in all, and linked ones by less
    than n / 6: larger sets need more groups to be told apart."""
    return 1 << max(GROUPS, min(MOST_GROUPS, largest // 8)).bit_length() - 1


def _groups_of(sizes: np.ndarray) -> np.ndarray:
    """``groups_for`` of each set."""
    return 1 << np.floor(np.log2(np.clip(sizes // 8, GROUPS, MOST_GROUPS))).astype(np.int64)


def sieve_of(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the top bits of the keys' hashes, set where a key has it: about 64 bits a key, 16 MB at most."""
    bits = min(max(int(keys.count()) * 64, 1 << 16).bit_length(), SIEVE)
    place = F.expr(f"shiftrightunsigned(k, {64 - bits}) + 1")
    found = keys.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
    found = found.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("held")).toArrow()
    sieve = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for part, held in zip(found["part"].to_pylist(), found["held"]):
        sieve[(part - 1) * 4096:part * 4096] = np.frombuffer(held.as_buffer(), dtype=np.uint8)
    return sieve


def _sieved(keys: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    place = (keys >> U64(64 - (8 * len(sieve) - 1).bit_length())).astype(np.int64)
    return (sieve[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def points(docs: DataFrame, text: str, shingle: int, percent: int, frequent: np.ndarray, sieve: np.ndarray) -> DataFrame:
    """``a, b, point, keys``: the group counts of every class as 32-bit numbers, in ``groups_for`` of its size groups, and its keys that the sieve holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                sets = Sets(texts, shingle)
                one, two = sets.identity()
                groups = np.where(sets.size > 0, _groups_of(sets.size), 0)
                first = np.append(0, np.cumsum(groups))
                flat = first[sets.doc] + (mix(sets.hash) & (groups[sets.doc] - 1).astype(U64)).astype(np.int64)
                counts = np.bincount(flat, minlength=first[-1]).astype("<u4")
                column = pa.Array.from_buffers(pa.binary(), len(groups), [None, pa.py_buffer((4 * first).astype(np.int32)), pa.py_buffer(counts.tobytes())])
                keys, doc = cell_keys(sets, percent, frequent)
                held = _sieved(keys, sieve)
                keys, doc = keys[held], doc[held]
                order = np.argsort(doc, kind="stable")
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc[order], np.arange(len(groups) + 1)).astype(np.int32)), pa.array(signed(keys[order])))
                some = np.unique(np.stack([one, two]), axis=1, return_index=True)[1]
                some = some[sets.size[some] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(signed(one[some])), pa.array(signed(two[some])), column.take(pa.array(some)), lists.take(pa.array(some))],
                                                 names=["a", "b", "point", "keys"])
    found = docs.select(text).mapInArrow(run, "a long, b long, point binary, keys array<long>").groupBy("a", "b").agg(F.first(F.struct("point", "keys")).alias("p"))
    return found.select("a", "b", "p.point", "p.keys")


def _folded(column: pa.ChunkedArray | list[np.ndarray]) -> np.ndarray:
    """Group counts of all rows, in as many groups as the row with the fewest: groups are low bits of a hash, so halves are added."""
    rows = [np.frombuffer(x if isinstance(x, np.ndarray) else x.as_buffer(), dtype="<u4") for x in column]
    groups = min(len(r) for r in rows)
    return np.stack([r.reshape(-1, groups).sum(axis=0) for r in rows]).astype(np.int32)


def near_points(counts: np.ndarray, sizes: np.ndarray, percent: int, sides: np.ndarray | None = None) -> np.ndarray:
    """For each point one point of its component, where points tie when the bound on their sets' overlap allows a link."""
    tree = RTree(counts, sizes)
    label = np.arange(len(sizes))
    for i in range(len(sizes)):
        near = tree.near(counts[i], int(sizes[i]), percent)
        near = near[label[near] != label[i]]
        if sides is not None:
            near = near[sides[near] != sides[i]]
        bound = np.minimum(counts[near], counts[i]).sum(axis=1)
        fits = ((100 + percent) * bound >= percent * (sizes[near] + sizes[i])) & (100 * sizes[near] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[near])
        for other in np.unique(label[near[fits]]).tolist():
            label[label == other] = label[i]
    return label


def near_pairs(rows: list[np.ndarray], sizes: np.ndarray, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """For each pair of points whether the bound on their sets' overlap allows a link. Points have as many groups as the one with fewer."""
    fits = (100 * sizes[one] >= percent * sizes[other]) & (100 * sizes[other] >= percent * sizes[one])
    groups = np.array([len(r) for r in rows])
    fewer = np.where(fits, np.minimum(groups[one], groups[other]), 0)
    for wide in np.unique(fewer[fits]).tolist():
        at = np.flatnonzero(fewer == wide)
        used, place = np.unique(np.concatenate([one[at], other[at]]), return_inverse=True)
        counts = np.stack([rows[i].reshape(-1, wide).sum(axis=0) for i in used.tolist()]).astype(np.int32)
        left, right = place[:len(at)], place[len(at):]
        for i in range(0, len(at), 4096):
            some = at[i:i + 4096]
            bound = np.minimum(counts[left[i:i + 4096]], counts[right[i:i + 4096]]).sum(axis=1)
            fits[some] = (100 + percent) * bound >= percent * (sizes[one[some]] + sizes[other[some]])
    return fits


def near_groups(column: pa.ChunkedArray, sizes: np.ndarray, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in the table that tie. Only points of one group are compared: those of a few points pair by pair, all at once, those of more by an R-tree each."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])) if len(order) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(order)))
    rows = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in column]
    ones, others = [], []
    for count in np.unique(many[(many > 1) & (many <= LEAF)]).tolist():
        low, high = np.triu_indices(count, 1)
        start = first[many == count][:, None]
        ones.append(order[(start + low).ravel()])
        others.append(order[(start + high).ravel()])
    if ones:
        one, other = np.concatenate(ones), np.concatenate(others)
        fits = near_pairs(rows, sizes, one, other, percent)
        ones, others = [one[fits]], [other[fits]]
    for start, count in zip(first[many > LEAF].tolist(), many[many > LEAF].tolist()):
        at = order[start:start + count]
        label = near_points(_folded([rows[i] for i in at.tolist()]), sizes[at], percent)
        ones.append(at)
        others.append(at[label])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *ones]), np.concatenate([none, *others])


def join_cell(values: np.ndarray, first: np.ndarray, percent: int, sides: np.ndarray | None = None) -> np.ndarray:
    """For each set of a cell, one set of its component, the same for all. With ``sides`` only pairs across the two sides are looked at.

    ``values[first[i]:first[i + 1]]`` is set i, sorted.
    """
    sizes = np.diff(first)
    count = len(sizes)
    groups = groups_for(int(sizes.max(initial=0)))
    flat = np.repeat(np.arange(count), sizes) * groups + (mix(values) & U64(groups - 1)).astype(np.int64)
    points = np.bincount(flat, minlength=count * groups).reshape(count, groups).astype(np.int32)
    tree = RTree(points, sizes)
    label = np.arange(count)
    for i in range(count):
        near = tree.near(points[i], int(sizes[i]), percent)
        near = near[(near > i) & (label[near] != label[i])]
        if sides is not None:
            near = near[sides[near] != sides[i]]
        near = near[(100 * sizes[near] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[near])]
        bound = np.minimum(points[near], points[i]).sum(axis=1)
        fits = (100 + percent) * bound >= percent * (sizes[near] + sizes[i])
        near = near[fits][np.argsort(-bound[fits], kind="stable")]
        own = values[first[i]:first[i + 1]]
        while len(near):
            some, near = near[:LEAF], near[LEAF:]
            for j in some.tolist():
                if label[j] == label[i]:
                    continue
                other = values[first[j]:first[j + 1]]
                place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                shared = int((own[place] == other).sum())
                if 100 * shared >= percent * (int(sizes[i]) + int(sizes[j]) - shared):
                    label[label == label[j]] = label[i]
            near = near[label[near] != label[i]]
    return label


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    column = column if isinstance(column, pa.Array) else column.chunk(0)
    first = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    return column.flatten().to_numpy().view(U64), first


def _sides(table: pa.Table) -> np.ndarray | None:
    sides = table["block"].to_numpy()
    return sides if sides.min() < sides.max() else None


def _stars(table: pa.Table, root: np.ndarray) -> pa.Table:
    linked = np.flatnonzero(root != np.arange(len(root)))
    root = root[linked]
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    return pa.table({"a": a[linked], "b": b[linked], "c": a[root], "d": b[root], "alone": table["alone"].take(pa.array(linked))})


TIE = "a long, b long, c long, d long"
LINK = f"{TIE}, alone boolean"


def tasks_of(heads: DataFrame, percent: int, cell_limit: int = CELL, values: int = VALUES) -> DataFrame:
    """The rows (``cell, a, b, n`` and others) with ``block, blocks, pairs``: where each class is joined.

    The classes of a cell are dealt into blocks in order of size: at most ``cell_limit`` classes, and so few of each power of two of the
    size that they have ``values`` shingles at most. Positions are counted in ranges of the whole table, so no task holds a large cell. Each
    block is joined with itself and with every later block of its cell whose smallest set can link with its largest: ``pairs`` lists the
    block pairs that need the class.
    """
    sized = settled(heads.withColumn("octave", F.length(F.bin("n")).cast("long") - 1))
    limit = F.greatest(F.lit(1), F.least(F.lit(cell_limit), F.expr(f"{values}L div shiftleft(1L, cast(octave as int) + 1)")))
    placed = RowOrder(("cell", "octave"), ("n", "a", "b"), smallest_sample=WINDOW_ROWS).positions(sized, "place").withColumn("limit", limit)
    placed = settled(placed.withColumn("block", F.expr("shiftleft(octave, 40) + place div limit")).drop("octave", "place", "limit"))
    blocks = placed.groupBy("cell", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    later = blocks.select(F.col("cell").alias("c"), F.col("block").alias("other"), F.col("low").alias("other_low"))
    pairs = blocks.join(later, (F.col("cell") == F.col("c")) & (F.col("other") >= F.col("block")) & (F.col("other_low") * percent <= F.col("high") * 100))
    pair = F.struct("block", "other")
    ends = pairs.select("cell", pair.alias("pair"), F.explode(F.array_distinct(F.array("block", "other"))).alias("part"))
    places = ends.groupBy("cell", F.col("part").alias("block")).agg(F.collect_list("pair").alias("pairs"))
    number = blocks.groupBy("cell").agg(F.count(F.lit(1)).alias("blocks"))
    return placed.join(places, ["cell", "block"]).join(number, "cell")


def _by_pair(rows: DataFrame) -> DataFrame:
    """A row for each block pair that needs the class; ``alone`` says that the cell is one block, so that links found are whole components."""
    dealt = rows.withColumn("alone", F.col("blocks") == 1).withColumn("pair", F.explode("pairs")).drop("pairs", "blocks")
    return dealt.groupBy("cell", "pair")


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links of classes to one of their component, from ``cell, block, blocks, pairs, a, b, set``."""
    def join_pair(table: pa.Table) -> pa.Table:
        return _stars(table, join_cell(*_lists(table["set"]), percent, _sides(table)))

    return _by_pair(sets).applyInArrow(join_pair, LINK)


def ties_by_key(keyed: DataFrame, percent: int, rows: int) -> DataFrame:
    """Links of classes whose points tie and that share a key, from ``k, a, b, n, point``. Tasks get the keys of a hash, about ``KEYED`` rows each."""
    def tie(table: pa.Table) -> pa.Table:
        one, other = near_groups(table["point"], table["n"].to_numpy(), table["k"].to_numpy(), percent)
        a, b = table["a"].to_numpy(), table["b"].to_numpy()
        # a class has a place for each of its keys; what leaves the task is a link for each class
        place = np.unique(np.stack([a, b]), axis=1, return_inverse=True)[1].ravel()
        some = np.zeros(len(a), np.int64)
        some[place] = np.arange(len(a))
        nodes, roots = stars(place[one], place[other])
        nodes, roots = some[nodes[nodes != roots]], some[roots[nodes != roots]]
        return pa.table({"a": a[nodes], "b": b[nodes], "c": a[roots], "d": b[roots]})

    shards = max(width(keyed.sparkSession), rows // KEYED)
    return keyed.groupBy(F.pmod(F.xxhash64("k"), F.lit(shards)).alias("shard")).applyInArrow(tie, TIE)


def smaller_cells(heads: DataFrame, docs: DataFrame, text: str, shingle: int, percent: int, groups: DataFrame, frequent: np.ndarray,
                  cell_limit: int = CELL, values: int = VALUES) -> DataFrame:
    """The classes with cells of more than one block cut into smaller ones, before any set is moved.

    Keys tie documents that share little, and such ties add up to cells of very many classes. Their points, a sixteenth of the sets, are joined
    first, by the bound on the overlap alone: classes that share a key, or all pairs of the cell where those are fewer. Classes that the bound cannot
    tell apart, directly or through others, are the new cells; a class alone in its cell links with nothing.
    """
    heads = settled(heads)
    sizes = settled(heads.groupBy("cell").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("shingles")))
    large = (F.col("classes") > cell_limit) | (F.col("shingles") > values)
    if sizes.where(large).isEmpty():
        return heads
    known = meet(heads, sizes, ["cell"], "classes")
    again = settled(known.where(large).drop("classes", "shingles"))
    sieve = sieve_of(groups.join(again.select(F.col("a").alias("head")), "head", "left_semi").select("k"))
    pointed = settled(again.select("cell", "a", "b", "n").join(points(docs, text, shingle, percent, frequent, sieve), ["a", "b"]))
    points_of = pointed.select("a", "b", "point")
    keyed = pointed.select("cell", "a", "b", "n", F.explode("keys").alias("k"))
    shared = settled(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("cell").alias("cell")).where("m > 1"))
    work = shared.groupBy("cell").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("work"), F.sum("m").alias("rows"), F.max("m").alias("most"))
    work = settled(work.join(sizes, "cell").withColumn("dense", F.col("work") >= F.col("classes").cast("double") * F.col("classes")))
    sums = work.groupBy("dense").agg(F.sum("rows").alias("rows"), F.max("most").alias("most")).collect()
    dense, rows, most = any(r["dense"] for r in sums), sum(r["rows"] for r in sums if not r["dense"]), max([r["most"] for r in sums if not r["dense"]], default=0)

    def tie(table: pa.Table) -> pa.Table:
        return _stars(table, near_points(_folded(table["point"]), table["n"].to_numpy(), percent, _sides(table)))

    parts, blocks = [], []
    if dense:
        whole = F.broadcast(work.where("dense").select("cell"))
        blocks.append(pointed.join(whole, "cell", "left_semi").select("cell", "a", "b", "n"))
        pointed = pointed.join(whole, "cell", "left_anti")
    keyed = pointed.select("a", "b", "n", "point", F.explode("keys").alias("k"))
    if most > cell_limit:
        # there are few keys of so many classes: less than a part in cell_limit of all
        hot = F.broadcast(shared.where(F.col("m") > cell_limit).select("k"))
        blocks.append(keyed.join(hot, "k", "left_semi").select(F.col("k").alias("cell"), "a", "b", "n"))
        keyed = keyed.join(hot, "k", "left_anti")
    if rows:
        parts.append(ties_by_key(keyed, percent, rows))
    if blocks:
        tasks = tasks_of(blocks[0] if len(blocks) == 1 else blocks[0].unionByName(blocks[1]), percent, cell_limit, 16 * values)
        parts.append(_by_pair(tasks.join(points_of, ["a", "b"])).applyInArrow(tie, LINK).drop("alone"))
    if not parts:
        return known.where(~large).drop("classes", "shingles")
    links = settled(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    ends = links.select(F.struct("a", "b").alias("node"), F.struct(F.col("c").alias("a"), F.col("d").alias("b")).alias("root"))
    found = components(ends, "node", "root").select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.col("root.a").alias("cell"))
    return known.where(~large).drop("classes", "shingles").unionByName(again.drop("cell").join(found, ["a", "b"]))


def rooted(docs: DataFrame, key: str, text: str, shingle: int, percent: int, cell_limit: int = CELL, values: int = VALUES) -> tuple[DataFrame, DataFrame]:
    """The signatures of all documents, and ``a, b, head, root`` of every class: its first row (``none, key, t``) and one class of its component."""
    signed_docs = settled(signatures(docs, key, text, shingle))
    # equal sets are one class; its smallest key, and the document of that key whose text is read again
    classes = signed_docs.where("n > 0").groupBy("a", "b", "n").agg(
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t")).alias("head"))
    frequent = frequent_keys(docs, text, shingle, percent)
    links, groups = key_groups(docs, text, shingle, percent, frequent)
    heads = classes.join(cells(links), "a").select("cell", "a", "b", "n", "head.key", "head.t")
    heads = smaller_cells(heads, docs, text, shingle, percent, groups, frequent, cell_limit, values)
    # one row for each text that is read again; null keys get a number so that the join has plain columns
    chosen = tasks_of(heads, percent, cell_limit, values).select(
        F.coalesce("key", F.lit(FAR)).alias("k"), "t", "cell", "block", "blocks", "pairs")
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(FAR)).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    again = texts.join(chosen, ["k", "t"]).groupBy("k", "t").agg(*[F.first(c).alias(c) for c in ("text", "cell", "block", "blocks", "pairs")])
    links = settled(class_links(shingle_sets(again, "text", shingle), percent))
    ends = links.select(F.struct("a", "b").alias("node"), F.struct(F.col("c").alias("a"), F.col("d").alias("b")).alias("root"), "alone")
    # cells of several blocks are put together from what their block pairs found
    across = components(ends.where("not alone"), "node", "root")
    linked = ends.where("alone").select("node", "root").unionByName(across)
    named = linked.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), "root")
    known = classes.select("a", "b", "head").join(named, ["a", "b"], "left").withColumn(
        "root", F.coalesce("root", F.struct("a", "b")))
    return signed_docs, known


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
           cell_limit: int = CELL, values: int = VALUES) -> DataFrame:
    """``key, t, a, b, n_shingles, component_id``, a row for each document (``t`` is a hash of its text)."""
    signed_docs, known = rooted(docs, key, text, shingle, percent, cell_limit, values)
    known = known.select("a", "b", "head.key", "root")
    labels = known.groupBy("root").agg(F.min("key").alias("component_id"))
    by_class = known.join(labels, "root").select("a", "b", "component_id")
    out = signed_docs.join(by_class, ["a", "b"], "left")
    return out.select("key", "t", "a", "b", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that keep their text: of each component the one with the smallest key (and, among rows of that key,
    the smallest text hash). Texts without a word, which link with nothing, all stay; so does a null key's row if nothing else is in its component.
    Components are told apart by their root and not by the smallest key, which several may share."""
    _, known = rooted(docs, key, text, shingle, percent)
    keep = known.groupBy("root").agg(F.min("head").alias("head"))
    none, number, hashed, row = fresh(docs, "no_key", "keeper", "text_hash", "row_number")

    def marked(key: Column, t: Column) -> list[Column]:
        key = key.cast("long")
        return [key.isNull().alias(none), F.coalesce(key, F.lit(0)).alias(number), t.alias(hashed)]

    # joined and numbered by the same plain columns, so that texts move once
    named = docs.select("*", *marked(F.col(key), F.xxhash64(text)))
    kept = named.join(keep.select(*marked(F.col("head.key"), F.col("head.t"))), [none, number, hashed], "left_semi")
    one = Window.partitionBy(none, number, hashed, key).orderBy(key)
    kept = kept.withColumn(row, F.row_number().over(one)).where(F.col(row) == 1)
    loose = docs.where(F.col(text).isNull() | ~F.col(text).cast("string").rlike(WORD))
    return kept.select(docs.columns).unionByName(loose.select(docs.columns))
