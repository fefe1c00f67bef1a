"""Connected components of a table of links, by contracting the graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillbar.llm.frames import settled


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links and the smallest node of its component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = place[:len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[one], label[other])
        new = label.copy()
        for end in (one, other, label[one], label[other]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _tied(links: DataFrame) -> DataFrame:
    """The links of every partition replaced by the stars of its components: as connected, and fewer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if parts:
            nodes, roots = stars(*(np.concatenate(side) for side in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["a", "b"])
    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame, one: str, other: str) -> DataFrame:
    """``node, root`` for every node of the links, the root being one node of the component.

    Each round links are contracted within their partition (where nodes are numbers), then every node points to the smallest
    node among itself and its neighbours, and the links between the nodes pointed to form the next, smaller graph. With hashed
    ids the nodes shrink by a constant factor a round, so there are at most about log(nodes) rounds. Null ends are left out. Each
    round's tables are kept in the shared folder.
    """
    edges = links.select(F.col(one).alias("a"), F.col(other).alias("b")).where("a is not null and b is not null")
    tie = _tied if edges.schema["a"].dataType.typeName() == "long" else (lambda rows: rows)

    def both_ways(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct()

    open_edges = settled(both_ways(tie(edges)))
    roots = open_edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    open_edges = open_edges.where("a <> b")
    while not open_edges.isEmpty():
        # a third of all links may lead to one node: smallest neighbours are pre-aggregated before the shuffle
        smallest = settled(open_edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        ahead = smallest.select(F.col("a").alias("root"), F.col("to").alias("next"))
        roots = roots.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        left = smallest.select("a", F.col("to").alias("x"))
        right = smallest.select(F.col("a").alias("b"), F.col("to").alias("y"))
        contracted = open_edges.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        open_edges = settled(both_ways(tie(contracted))).where("a <> b")
    return settled(roots)
