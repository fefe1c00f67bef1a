"""Importance resampling against plain counting."""

import zlib

import numpy as np
import pytest
from hypothesis import given, strategies as st
from rows import ODD

import brute
from quillbar.llm import importance

TARGET = ["opening words here one two three", "a b c\nd e f g", None, "é ü 日本 x", ""]


def ordered(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")


@given(st.lists(st.binary(max_size=90), max_size=6))
def test_checksums_of_ranges(parts):
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
    state = importance.crc_after(np.full(len(parts), 0xFFFFFFFF, dtype=np.uint32), data, ends - [len(p) for p in parts], ends)
    assert (state ^ np.uint32(0xFFFFFFFF)).tolist() == [zlib.crc32(p) for p in parts]


@given(st.lists(st.text(st.sampled_from("aZ09 -_\n`{é日\x00\x7f"), max_size=12), max_size=5), st.integers(1, 3))
def test_runs_of_words(texts, ngrams):
    raw = [t.encode() for t in texts]
    bounds = np.append(0, np.cumsum([len(t) for t in raw])).astype(np.int64)
    text, bucket = importance.Words(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds).runs(ngrams, 10_000)
    want = [(i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in brute.runs(t, ngrams)[1]]
    assert sorted(zip(text.tolist(), bucket.tolist())) == sorted(want)


@pytest.mark.parametrize("options", [{}, {"hot_rows": 0, "smallest_sample": 0}, {"ngrams": 2, "buckets": 70_000}, {"ngrams": 3, "hot_rows": 0, "least_words": 1, "percent": 60}])
def test_weights_and_draw(spark, target, options):
    rows = [(r[0], r[1]) for r in ODD] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, drawn = brute.importance(rows, TARGET, options.get("ngrams", 1), options.get("buckets", 10_000), options.get("percent", 10), options.get("least_words", 20))
    got = importance.ranked(docs, target, **options).collect()
    assert ordered((r["key"], r["n_features"], r["weight"], r["score"]) for r in got) == ordered(want)
    ranks = sorted((r["rank"], -r["score"], r["key"] is None, r["key"] or 0) for r in got if r["rank"] is not None)
    assert ranks == [(i + 1, *d) for i, d in enumerate(drawn)] and drawn


def test_lines_are_hashed_once_wherever_they_stand(spark, target):
    """Runs of words over the ends of lines count like any other, and lines shared by many documents are one segment."""
    line = "a very common line of some ten words or so"
    rows = [(i, f"{line}\nown{i} words{i}\n\n{line}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for ngrams in (1, 3):
        got = importance.ranked(docs, target, ngrams=ngrams, hot_rows=10).collect()
        assert ordered((r["key"], r["n_features"], r["weight"], r["score"]) for r in got) == ordered(brute.importance(rows, TARGET, ngrams)[0])
    found = importance.segments(docs.withColumnRenamed("doc_id", "k"), "text", 1, 10_000).collect()
    assert sorted(r["occurrences"] for r in found) == [1] * 40 + [40, 80]


def test_drawn_rows(spark, target, clashing, none):
    docs = clashing.unionByName(clashing).unionByName(clashing)
    for percent in (10, 50, 100):
        _, drawn = brute.importance([(r[0], r[1]) for r in ODD] * 3, TARGET, percent=percent)
        got = importance.drawn(docs, target, percent=percent)
        assert got.columns == docs.columns
        assert ordered(r["doc_id"] for r in got.collect()) == ordered(None if missing else i for _, missing, i in drawn)
    assert importance.ranked(none, target).count() == importance.drawn(none, target).count() == 0


def test_empty_target(spark, odd, target):
    rows = importance.ranked(odd, target.where("false")).collect()
    assert ordered((r["key"], r["n_features"], r["weight"], r["score"]) for r in rows) == ordered(brute.importance([(r[0], r[1]) for r in ODD], [])[0])
