"""Product quantisation of integer vectors; Lloyd's rounds on partition-local cover trees.

Every component x becomes ``floor(4096 * x)``, vectors are cut into ``parts`` equal parts, and each part has a codebook of its own. A round assigns every
part to its nearest entry (squared Euclidean distance, ties to the lower index) and moves each entry to the floor of its parts' mean.

1. **Trees, once.** Each partition is cut into blocks of ``BLOCK`` vectors. Of each part of a block's vectors a cover tree is built: a node is a ball
   around one of its points, and its children are a net of its points at half its radius. A node's points stand next to each other,
   so running sums over them give the sum of every node. Blocks and trees are kept in the shared folder; no vector is shuffled.
2. **Rounds.** A ball whose nearest entry is nearer to its centre than any other by more than its diameter goes to that entry as a
   whole. Other entries too far by this rule are dropped for the subtree, and the children are asked; points of ambiguous leaves are compared
   exactly. Distances are integers; the rule, in floating point, leaves a margin that only makes it ask more. What leaves a task is a
   sum and a count for each entry, ``parts * entries * (length / parts + 1)`` numbers at any size of the table; sums beyond 64 bits are cut into limbs.
3. **Codes.** A last pass assigns all parts again and writes codes and errors. Errors by label are aggregated before the shuffle, and labels
   with a large part of all rows are broadcast (``frames.meet``).

Results are exact, so they depend neither on partitions nor on blocks.

Defined cases: rows whose vector is null or empty or has null or non-finite components take no part. The vectors' length is that of the
first row (smallest id) whose length is a positive multiple of ``parts``; rows of another length take no part. With fewer rows than entries the codebook has that
many. Null ids come last in the order, equal ids go by vector. Components so large that distances leave 64 bits are compared in Python
integers, without a tree; an error above 2**63 - 1 is given as that. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from quillbar.llm.frames import HOT_ROWS, meet, settled

SCALE = 4096.0
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 1 << 14
LEAF = 16
LIMB = 40
MOST = 2**63 - 1


class CoverTree:
    """Points in tree order and, level by level, the nodes over them.

    ``order[i]`` is the row of point i. Node j covers the points ``low[j]:high[j]``, the first of which is its centre, within ``radius[j]``;
    its children are the nodes ``child[j]:child[j] + children[j]``, none for a leaf.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.points, self.order, self.radius = points, order, radius
        self.low, self.high, self.child, self.children = nodes

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        order = np.arange(len(points))
        levels, radii = [], []
        low, high = np.array([0]), np.array([len(points)])
        made = 1
        while len(low):
            sizes = high - low
            node = np.repeat(np.arange(len(low)), sizes)
            place = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
            own = points[order[place]]
            far = np.maximum.reduceat(((own - points[order[low]][node]) ** 2).sum(axis=1), np.cumsum(sizes) - sizes)
            opened = (sizes > leaf) & (far > 0)
            net = cls._net(own, node, far, opened)
            inner = np.flatnonzero(opened[node])
            moved = inner[np.lexsort((net[inner], node[inner]))]
            order[place[inner]] = order[place[moved]]
            # children stand in the order of their nodes; a new one begins where node or net centre changes
            group = np.stack([node[moved], net[moved]])
            begins = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0))) if len(moved) else np.zeros(0, np.int64)
            parent = node[moved][begins]
            count = np.bincount(parent, minlength=len(low))
            levels.append(np.stack([low, high, made + np.cumsum(count) - count, count]))
            radii.append(np.sqrt(far.astype(np.float64)))
            made += len(begins)
            low = place[inner][begins]
            high = low + np.diff(np.append(begins, len(moved)))
        return cls(points[order], order, np.concatenate(levels, axis=1), np.concatenate(radii))

    @staticmethod
    def _net(own: np.ndarray, node: np.ndarray, far: np.ndarray, opened: np.ndarray) -> np.ndarray:
        """For each point the number of the first net centre of its node within half the radius; nodes are done in step."""
        net = np.zeros(len(own), dtype=np.int64)
        left = np.flatnonzero(opened[node])
        number = 0
        while len(left):
            # the first point of each node that no centre covers is the next centre
            at = node[left]
            head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            centre = np.repeat(left[head], np.diff(np.append(head, len(left))))
            near = 4 * ((own[left] - own[centre]) ** 2).sum(axis=1) <= far[at]
            net[left[near]] = number
            left = left[~near]
            number += 1
        return net

    def assign(self, centres: np.ndarray) -> tuple[np.ndarray, int]:
        """The nearest centre of every point, in tree order, and how many points were compared one by one."""
        code = np.zeros(len(self.points), dtype=np.int64)
        compared = 0
        nodes, open_to = np.array([0]), np.ones((1, len(centres)), dtype=bool)
        while len(nodes):
            far = _squares(self.points[self.low[nodes]], centres)
            distance = np.where(open_to, np.sqrt(far.astype(np.float64)), np.inf)
            nearest = distance.min(axis=1)
            reach = nearest + 2 * self.radius[nodes]
            open_to = distance <= (reach + 1e-9 * (reach + nearest) + 1e-6)[:, None]
            sure = open_to.sum(axis=1) == 1
            self._fill(code, nodes[sure], open_to[sure].argmax(axis=1))
            leaf = ~sure & (self.children[nodes] == 0)
            place, of = _ranges(self.low[nodes[leaf]], self.high[nodes[leaf]])
            if len(place):
                exact = np.where(open_to[leaf][of], _squares(self.points[place], centres), MOST)
                code[place] = exact.argmin(axis=1)
                compared += len(place)
            inner = ~sure & ~leaf
            first = self.child[nodes[inner]]
            nodes, of = _ranges(first, first + self.children[nodes[inner]])
            open_to = open_to[inner][of]
        return code, compared

    def sums(self, centres: np.ndarray) -> np.ndarray:
        """For each centre the sum of its points and, last, their number."""
        code, _ = self.assign(centres)
        # points of one subtree are neighbours and mostly share a code: differences of running sums over runs of equal codes
        begins = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        ends = np.append(begins[1:], len(code))
        run = np.concatenate([np.zeros((1, self.points.shape[1]), dtype=np.int64), np.cumsum(self.points, axis=0)])
        out = np.zeros((len(centres), self.points.shape[1] + 1), dtype=np.int64)
        np.add.at(out, code[begins], np.column_stack([run[ends] - run[begins], ends - begins]))
        return out

    def _fill(self, code: np.ndarray, nodes: np.ndarray, value: np.ndarray) -> None:
        place, of = _ranges(self.low[nodes], self.high[nodes])
        code[place] = value[of]

    def packed(self) -> list[bytes]:
        nodes = np.stack([self.low, self.high, self.child, self.children])
        return [self.points.astype("<i4").tobytes(), self.order.astype("<i4").tobytes(), nodes.astype("<i4").tobytes(), self.radius.astype("<f8").tobytes()]

    @classmethod
    def unpacked(cls, parts: list[bytes], width: int) -> CoverTree:
        points, order, nodes = (np.frombuffer(x, dtype="<i4").astype(np.int64) for x in parts[:3])
        return cls(points.reshape(-1, width), order, nodes.reshape(4, -1), np.frombuffer(parts[3], dtype="<f8"))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and which range each is of."""
    sizes = high - low
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of], of


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points by centres; exact for the integers in use."""
    out = np.zeros((len(points), len(centres)), dtype=points.dtype)
    for j in range(centres.shape[1]):
        out += (points[:, j, None] - centres[None, :, j]) ** 2
    return out


def largest_component(length: int) -> int:
    """Up to this size differences of whole vectors have a square that stays within 62 bits."""
    return min(int(2**30 / math.sqrt(length)), 2**31 - 1)


class Block:
    """Some vectors of one partition: trees for each part, or the components themselves where 64 bits do not hold their distances."""

    def __init__(self, trees: list[CoverTree] | None, wide: np.ndarray | None, parts: int):
        self.trees, self.wide, self.parts = trees, wide, parts

    @classmethod
    def of(cls, rows: np.ndarray, parts: int) -> Block:
        """From floored components (whole doubles)."""
        if np.abs(rows).max(initial=0) > largest_component(rows.shape[1]):
            return cls(None, rows, parts)
        return cls([CoverTree.build(p) for p in np.split(rows.astype(np.int64), parts, axis=1)], None, parts)

    def packed(self) -> list[bytes]:
        return [self.wide.tobytes()] if self.trees is None else [x for tree in self.trees for x in tree.packed()]

    @classmethod
    def unpacked(cls, kept: list[bytes], length: int, parts: int) -> Block:
        if len(kept) == 1:
            return cls(None, np.frombuffer(kept[0]).reshape(-1, length), parts)
        return cls([CoverTree.unpacked(kept[4 * p:4 * p + 4], length // parts) for p in range(parts)], None, parts)

    def _exact(self, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part of a wide block: its vectors, codes and squared distances in Python integers."""
        whole = np.array([[int(x) for x in row] for row in self.wide.tolist()], dtype=object)
        for part, book in zip(np.split(whole, self.parts, axis=1), books):
            far = _squares(part, book)
            code = np.array([min(range(len(book)), key=row.__getitem__) for row in far.tolist()])
            yield part, code, far[np.arange(len(code)), code]

    def sums(self, books: np.ndarray) -> np.ndarray:
        if self.trees is not None:
            return np.stack([tree.sums(_small(book)) for tree, book in zip(self.trees, books)]).astype(object) if _fits(books) else self._plain(books)
        out = np.zeros((self.parts, books.shape[1], books.shape[2] + 1), dtype=object)
        for p, (part, code, _) in enumerate(self._exact(books)):
            np.add.at(out[p], code, np.column_stack([part, np.ones(len(part), dtype=object)]))
        return out

    def _plain(self, books: np.ndarray) -> np.ndarray:
        return self._as_wide().sums(books)

    def _as_wide(self) -> Block:
        """The same vectors without trees, for codebooks whose entries are too large for 64 bits."""
        rows = []
        for tree in self.trees:
            part = np.empty(tree.points.shape)
            part[tree.order] = tree.points
            rows.append(part)
        return Block(None, np.concatenate(rows, axis=1), self.parts)

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Codes (rows by parts) and the error of each row."""
        if self.trees is None:
            found = [(code, far) for _, code, far in self._exact(books)]
            return np.stack([code for code, _ in found], axis=1), [min(int(x), MOST) for x in sum(far for _, far in found)]
        if not _fits(books):
            return self._as_wide().codes(books)
        codes = np.zeros((len(self.trees[0].order), self.parts), dtype=np.int64)
        error = np.zeros(len(codes), dtype=np.int64)
        for p, (tree, book) in enumerate(zip(self.trees, books)):
            code, _ = tree.assign(_small(book))
            codes[tree.order, p] = code
            error[tree.order] += ((tree.points - _small(book)[code]) ** 2).sum(axis=1)
        return codes, error.tolist()


def _fits(books: np.ndarray) -> bool:
    return bool(np.abs(books).max(initial=0) <= largest_component(books.shape[0] * books.shape[2]))


def _small(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64)


def kept_rows(vectors: DataFrame, key: str, vector: str, label: str, parts: int) -> tuple[DataFrame, int, list]:
    """``key, label, vector`` of the rows that take part, the vectors' length, and the first vectors in order of key."""
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0) & finite)
    order = [F.col("key").asc_nulls_last(), F.col("vector")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return rows, 0, []
    rows = rows.where(F.size("vector") == len(first[0]["vector"]))
    return rows, len(first[0]["vector"]), [r["vector"] for r in rows.orderBy(*order).limit(ENTRIES).collect()]


def blocks(rows: DataFrame, length: int, parts: int, block: int = BLOCK) -> DataFrame:
    """``keys, labels, kept``: the vectors of each partition in blocks, with their trees."""
    kinds = rows.schema["key"].dataType, rows.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(some).combine_chunks()
            values = table["vector"].combine_chunks()
            whole = np.floor(SCALE * np.asarray(values.flatten(), dtype=np.float64).reshape(-1, length))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table[c].combine_chunks()) for c in ("key", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([Block.of(whole, parts).packed()], pa.list_(pa.binary()))], names=["keys", "labels", "kept"])

        waiting, count = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - count)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                count += part.num_rows
                if count == block:
                    yield made(waiting)
                    waiting, count = [], 0
        if count:
            yield made(waiting)

    return rows.mapInArrow(run, StructType().add("keys", ArrayType(kinds[0])).add("labels", ArrayType(kinds[1])).add("kept", ArrayType(BinaryType())))


def moved(trees: DataFrame, books: np.ndarray, length: int) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), dtype=object)
        for batch in batches:
            for kept in batch.column(0):
                total = total + Block.unpacked([x.as_buffer() for x in kept], length, parts).sums(books)
        rows = []
        for slot, value in enumerate(total.ravel().tolist()):
            limb = 0
            while value:  # the last limb has the sign
                rest = value if -(1 << LIMB) < value < 1 << LIMB else value & ((1 << LIMB) - 1)
                rows.append((slot, limb, rest))
                value, limb = (value - rest) >> LIMB, limb + 1
        slots, limbs, values = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (slots, limbs, values)], names=["slot", "limb", "value"])

    total = [0] * books[..., 0].size * (width + 1)
    summed = trees.select("kept").mapInArrow(run, "slot long, limb long, value long").groupBy("slot", "limb").agg(F.sum("value").alias("value"))
    for slot, limb, value in summed.collect():
        total[slot] += value << (LIMB * limb)
    total = np.array(total, dtype=object).reshape(parts, entries, width + 1)
    used = total[..., -1] > 0
    out = books.copy()
    out[used] = total[..., :-1][used] // total[..., -1:][used]
    return out


def coded(trees: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """``key, label, code, error`` of every vector."""
    parts = len(books)
    kinds = trees.schema["keys"].dataType.elementType, trees.schema["labels"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, error = Block.unpacked([x.as_buffer() for x in batch.column(2)[i]], length, parts).codes(books)
                text = np.array([f"{x:02x}" for x in range(books.shape[1])])[codes]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values, pa.array(["".join(row) for row in text.tolist()], pa.string()), pa.array(error, pa.int64())],
                    names=["key", "label", "code", "error"])

    return trees.select("keys", "labels", "kept").mapInArrow(
        run, StructType().add("key", kinds[0]).add("label", kinds[1]).add("code", StringType()).add("error", LongType()))


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, rounds: int = ROUNDS,
               block: int = BLOCK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``key, label, code, error, label_error, codebooks_sha256``: a row for each vector that takes part."""
    rows, length, first = kept_rows(vectors, key, vector, label, parts)
    if not first:
        return rows.select("key", "label", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")],
                           F.lit("").alias("codebooks_sha256")).where(F.lit(False))
    start = np.array([[math.floor(SCALE * x) for x in v] for v in first], dtype=object)
    books = np.stack(np.split(start, parts, axis=1))
    trees = settled(blocks(rows, length, parts, block))
    for _ in range(rounds):
        books = moved(trees, books, length)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = settled(coded(trees, books, length).withColumn("same", F.struct("label")))
    # a sum beyond 64 bits is given as the largest number
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    labels = settled(found.groupBy("same").agg(total.alias("label_error"), F.count(F.lit(1)).alias("rows")))
    return meet(found, labels, ["same"], "rows", hot_rows).select(
        "key", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
