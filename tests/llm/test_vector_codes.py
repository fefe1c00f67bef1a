"""Vector codes against Lloyd's rounds in Python integers."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import brute
from quillbar.llm import vector_codes
from quillbar.llm.vector_codes import CoverTree

SCHEMA = "vec_id long, label int, embedding array<float>"


def ordered(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").limit(150).collect()
    return [(r["vec_id"], r["label"], r["embedding"]) for r in rows]


def odd(vectors):
    z = [0.0] * 63
    return vectors[:60] + vectors[:5] + [
        (None, None, vectors[7][2]), (None, 3, vectors[8][2]), (900, None, None), (901, 1, []), (902, 1, [float("nan"), *z]),
        (903, 2, [float("inf"), *z]), (904, 2, [None, *z]), (905, 2, [1.0] * 8), (-1, 2, [1.0] * 7)]


LARGE = [(906, 3, [3e5] + [0.0] * 63), (907, 3, [1e30] * 64), (908, 4, [-1e38] * 64), (909, 4, [-3e5] * 64), (910, 3, [2e30] * 64)]


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 300), st.integers(1, 9), st.integers(1, 40), st.integers(0, 10**6), st.sampled_from([3, 50, 10**6]))
def test_tree_assigns_as_all_comparisons_do(count, width, entries, seed, spread):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread + 1, (count, width))
    points[rng.integers(0, count, count // 3)] = points[0]
    centres = np.concatenate([points[:entries], rng.integers(-spread, spread + 1, (2, width))])
    tree = CoverTree.build(points, leaf=4)
    assert sorted(tree.order.tolist()) == list(range(count)) and (tree.points == points[tree.order]).all()
    for low, high, radius in zip(tree.low, tree.high, tree.radius):
        assert np.sqrt(((tree.points[low:high] - tree.points[low]) ** 2).sum(axis=1)).max() <= radius + 1e-9
    far = ((tree.points[:, None] - centres[None]) ** 2).sum(axis=2)
    code, compared = tree.assign(centres)
    assert (code == far.argmin(axis=1)).all() and compared <= count
    sums = tree.sums(centres)
    for e in range(len(centres)):
        assert sums[e].tolist() == [*tree.points[code == e].sum(axis=0).tolist(), int((code == e).sum())]
    again = CoverTree.unpacked(tree.packed(), width)
    assert (again.assign(centres)[0] == code).all()


def test_whole_subtrees_are_assigned():
    """Tight clusters around the entries: hardly a point is compared by itself."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-10**5, 10**5, (16, 8))
    points = np.repeat(centres, 500, axis=0) + rng.integers(-50, 51, (8000, 8))
    code, compared = CoverTree.build(points).assign(centres)
    assert compared == 0 and np.bincount(code).tolist() == [500] * 16


@pytest.mark.parametrize("options", [{}, {"block": 7, "hot_rows": 0}])
def test_codes(spark, vectors, options):
    for rows in (vectors, odd(vectors), vectors[:3]):
        want = brute.vector_codes(rows)
        for parts in (1, 3):
            got = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(parts), **options)
            assert ordered(tuple(r) for r in got.collect()) == ordered(want)


def test_components_beyond_64_bits(spark, vectors):
    rows = odd(vectors) + LARGE
    for data in (rows, [(-5, 9, [2e30] * 64), *rows]):  # once an entry of the first codebook, too
        want = brute.vector_codes([(i, l, v and [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in data])
        got = vector_codes.compressed(spark.createDataFrame(data, SCHEMA).repartition(2), block=20)
        assert ordered(tuple(r) for r in got.collect()) == ordered(want)
        assert any(r[3] == 2**63 - 1 for r in want) or data is not rows


def test_empty_and_clashing(spark, vectors):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compressed(none).columns == vector_codes.compressed(none.unionByName(spark.createDataFrame([(1, 1, None)], SCHEMA))).columns
    assert vector_codes.compressed(none).count() == 0
    extra = spark.createDataFrame(vectors[:40], SCHEMA).withColumns({c: F.lit(c) for c in ("key", "code", "error", "same", "keys", "kept", "rows")})
    assert ordered(tuple(r) for r in vector_codes.compressed(extra).collect()) == ordered(brute.vector_codes(vectors[:40]))
