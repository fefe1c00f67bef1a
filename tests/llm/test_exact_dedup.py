"""Exact deduplication against a dictionary of texts."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, strategies as st
from rows import LONG, ODD
from pyspark.sql import functions as F

import brute
from quillbar.llm import exact_dedup
from quillbar.llm.words import byte_runs

TEXTS = [(r[0], r[1]) for r in ODD]


def ordered(rows):
    return sorted(rows, key=str)


def plain(data: bytes, moduli):
    return (len(data), *(sum((b + 1) * pow(base, i, p) for i, b in enumerate(data)) % p for base, p in zip(exact_dedup.BASES, moduli)))


@given(st.lists(st.binary(max_size=40), max_size=6), st.integers(1, 20))
def test_fingerprints_of_chunks_are_those_of_the_whole(texts, chunk):
    bounds = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    got = [exact_dedup.polynomial(data, bounds, which, p, chunk).tolist() for which, p in enumerate(exact_dedup.MODULI)]
    assert list(zip([len(t) for t in texts], *got)) == [plain(t, exact_dedup.MODULI) for t in texts]


@given(st.binary(max_size=60), st.binary(max_size=60))
def test_fingerprints_compose(left, right):
    join = exact_dedup.joined_hash(plain(left, exact_dedup.MODULI), plain(right, exact_dedup.MODULI))
    assert join == plain(left + right, exact_dedup.MODULI)


def test_runs_of_texts_cover_a_sliced_column():
    column = pa.array([b"skipped", b"one", b"", b"three", b"x" * 50]).slice(1)
    for limit in (1, 6, 1000):
        found = [(lo + i, data[a:b].tobytes()) for lo, _, data, bounds in byte_runs(column, limit) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
        assert found == list(enumerate([b"one", b"", b"three", b"x" * 50]))


@pytest.mark.parametrize("options", [
    {}, {"chunk": 64, "split_bytes": 1000, "hot_rows": 0},
    # so few fingerprints that most of them stand for different texts of one length
    {"chunk": 8, "split_bytes": 100, "moduli": (3, 2), "hot_rows": 0}, {"moduli": (2, 2)},
])
def test_groups_are_those_of_equal_texts(odd, options):
    want, texts = brute.exact_rows(TEXTS)
    rows = exact_dedup.judged(odd, **options).collect()
    assert ordered((r["key"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == ordered(want)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == texts == len({r["text_sha256"] for r in kept}) and all(r["key"] == r["keep_id"] for r in kept)


def test_colliding_texts_of_one_length_are_told_apart(spark):
    rows = [(i, "".join("ab"[i >> j & 1] for j in range(5)) * 30 + "same end") for i in range(32)] * 2 + [(99, ("A" * 5) * 30 + "SAME end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = exact_dedup.judged(docs, chunk=16, moduli=(2, 2)).collect()
    assert ordered((r["key"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == ordered(brute.exact_rows(rows)[0])


def test_rows_that_stay(odd, clashing, none):
    _, texts = brute.exact_rows(TEXTS)
    for docs in (odd, clashing, clashing.unionByName(clashing)):
        kept = exact_dedup.deduplicated(docs)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert len(rows) == texts == len({brute.lower(r["text"]) for r in rows})
        assert {r["doc_id"] for r in rows} >= {r[0] for r in ODD[:2]} | {10, 13}
    assert exact_dedup.judged(none).count() == exact_dedup.deduplicated(none).count() == 0


def test_hot_group_and_repeated_rows(spark):
    rows = [(i, "copied text") for i in range(60)] + [(7, "one row again")] * 50 + [(None, None)] * 40 + [(i, f"text {i}") for i in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for hot in (5, 10_000):
        got = exact_dedup.judged(docs, hot_rows=hot).collect()
        assert ordered((r["key"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == ordered(brute.exact_rows(rows)[0])
        assert sorted(r["key"] for r in got if r["kept"] and r["key"] is not None) == sorted([7, 59, *range(100, 130)])
        assert sum(r["kept"] for r in got) == 33


def test_long_text_is_cut_and_compared_in_chunks(spark):
    """A change in the last byte of a long text is seen whichever way it was hashed."""
    rows = [(1, LONG), (2, LONG.upper()), (3, LONG[:-1] + "!"), (4, LONG + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"split_bytes": 1 << 12, "chunk": 1 << 10}):
        prints = exact_dedup.fingerprints(docs, **options).select("k", "n", "h1", "h2").collect()
        assert len({tuple(r)[1:] for r in prints}) == 3
        got = {r["key"]: (r["keep_id"], r["kept"]) for r in exact_dedup.judged(docs, **options).collect()}
        assert got == {1: (2, False), 2: (2, True), 3: (3, True), 4: (4, True)}


def test_table_of_tests(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, _ = brute.exact_rows([(r["doc_id"], r["text"]) for r in docs.select("doc_id", F.col("text")).collect()])
    got = exact_dedup.judged(docs, hot_rows=0).collect()
    assert ordered((r["key"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == ordered(want)
