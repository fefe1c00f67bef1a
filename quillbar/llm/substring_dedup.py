"""Substring deduplication by relative Lempel-Ziv parsing.

Documents are dealt into reference blocks by a hash of their key. Each block indexes the word windows of
its own texts, and every document is parsed against all blocks: a factor is a run of windows that occur in
a document with a smaller key, as long as it can be, and its source. Factors of at least ``width`` words
become duplicate spans. A window that reaches over the end of one factor into the next is looked up like
any other, so that nothing is lost where two factors meet.

No document travels to a block that cannot hold a match. Every window of ``width`` words names one of its
``seed``-word sequences, the one with the smallest hash, so equal windows name equal seeds:

1. each block lists its distinct seeds; a window function over the seeds finds those of two or more blocks;
2. each block lists its distinct windows at those seeds, with the smallest document key, and a window function
   over the window hashes (128 bits) gives each block the sources that lie in other blocks, by the windows' place in its list;
3. each block parses its documents against its own index and these sources.

What is shuffled is the text (once, read three times), a row for each distinct seed of a block, and a row for each
distinct window at a shared seed. A passage that a third of all documents share is one row for each block.
A task holds one block (``block_bytes`` of text, or one longer document).

Defined cases: a null text has no words. A null key sorts after all others and is smaller than none; rows with the same key are
not duplicates of each other. Texts shorter than ``width`` words are never cut. An empty table gives an empty table. Other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from quillbar.llm.frames import BLOCK_BYTES, block_of, blocks_for, fresh
from quillbar.llm.words import Texts, signed, slices, windows

WIDTH = 13
SEED = 5
LAST = np.iinfo(np.int64).max


def _seeds(texts: Texts, words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The smallest seed hash of each window, texts not regarded."""
    m = len(words) - width + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    grams = windows(words, seed)
    best = grams[:m].copy()
    for j in range(1, width - seed + 1):
        np.minimum(best, grams[j:j + m], out=best)
    return best


def _first_of(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the smallest key of each, and the place of one window of that key."""
    order = np.lexsort((keys, hashes))
    sorted_hashes = hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    at = order[new]
    return sorted_hashes[new], keys[at], at


def _keys(table: pa.Table, name: str) -> np.ndarray:
    return table[name].fill_null(LAST).to_numpy().astype(np.int64, copy=False)


class _Index:
    """The windows of a block: hashes, document keys and rows."""

    def __init__(self, table: pa.Table, key: str, text: str, width: int, seed: int, second: bool = True):
        keys = _keys(table, key)
        parts = []
        for low, _, texts in slices(table[text]):
            words = texts.hashes()
            ok = texts.inside(width)
            m = len(ok)
            rows = texts.doc[:m][ok] + low
            parts.append((
                windows(words, width)[ok], windows(texts.hashes(1), width, 1)[ok] if second else np.zeros(0, np.uint64),
                _seeds(texts, words, width, seed)[ok] if seed else np.zeros(0, np.uint64), rows, keys[rows]))
        empty = np.zeros(0, np.uint64)
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [empty, empty, empty, empty.astype(np.int64), empty.astype(np.int64)]
        self.one, self.two, self.seed, self.row, self.key = columns


def _list_seeds(key: str, text: str, width: int, seed: int):
    def run(group: tuple, table: pa.Table) -> pa.Table:
        found = []
        for _, _, texts in slices(table[text]):
            smallest = _seeds(texts, texts.hashes(), width, seed)[texts.inside(width)]
            found.append(np.unique(smallest))
        distinct = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        return pa.table({"seed": signed(distinct), "block": pa.array(np.full(len(distinct), group[0].as_py(), dtype=np.int32))})
    return run


def _list_windows(key: str, text: str, width: int, seed: int):
    def run(group: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        index = _Index(table, key, text, width, seed)
        one, first, at = _first_of(index.one, index.key)
        live = np.flatnonzero(np.isin(signed(index.seed[at]), shared["seed"].to_numpy()))
        return pa.table({
            "one": signed(one[live]), "two": signed(index.two[at[live]]), "key": first[live],
            "block": pa.array(np.full(len(live), group[0].as_py(), dtype=np.int32)), "place": pa.array(live.astype(np.int32))})
    return run


def _sources(index: _Index, shared: pa.Table) -> np.ndarray:
    """The smallest key of a document that holds the window, here or in another block."""
    hashes, source, _ = _first_of(index.one, index.key)
    place, other = shared["place"].to_numpy(), shared["source"].to_numpy()
    best = source.copy()
    best[place] = np.minimum(source[place], other)
    return best[np.searchsorted(hashes, index.one)]


def factors(rows: np.ndarray, words: np.ndarray, sources: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Greedy factors from the duplicate windows of a block, in order: row, first word, words, source.

    ``words`` is the number of the window's first word in its text. A factor runs on while the next window comes from the same source.
    """
    if not len(rows):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (words[1:] != words[:-1] + 1) | (sources[1:] != sources[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(rows))) + width - 1
    return rows[begin], words[begin], length, sources[begin]


def _parsed(table: pa.Table, shared: pa.Table, key: str, text: str, width: int):
    """Yield for each slice of the block: first row, row after the last, texts, and the factors in it."""
    index = _Index(table, key, text, width, 0, second=False)
    source = _sources(index, shared)
    repeated = source < index.key
    done = 0
    for low, high, texts in slices(table[text]):
        ok = texts.inside(width)
        m = len(ok)
        here = int(ok.sum())
        dup = repeated[done:done + here]
        place = np.flatnonzero(ok)[dup]
        doc = texts.doc[:m][place]
        yield low, high, texts, factors(doc, place - texts.first[doc], source[done:done + here][dup], width)
        done += here


def _removed(texts: Texts, found: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which words lie in a factor."""
    doc, begin, length, _ = found
    change = np.zeros(len(texts.start) + 1, dtype=np.int64)
    np.add.at(change, texts.first[doc] + begin, 1)
    np.add.at(change, texts.first[doc] + begin + length, -1)
    return np.cumsum(change[:-1]) > 0


def _kept_bytes(texts: Texts, gone: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that stay and the bounds of each text in them: words with one space after each
    (``spaced``), or the text as it was but for removed words and the white space behind them."""
    n = len(texts.data)
    change = np.zeros(n + 1, dtype=np.int8)
    last = texts.offsets[1:][texts.doc]
    if spaced:
        keep = ~gone
        change[texts.start[keep]] += 1
        stop = np.minimum(texts.end[keep] + 1, last[keep])
        np.add.at(change, stop, -1)
        stay = np.cumsum(change[:-1], dtype=np.int8) > 0
        data = texts.data.copy()
        data[np.minimum(texts.end, n - 1)[texts.end < last]] = 32
    else:
        after = np.append(texts.start[1:], n)
        after = np.where(np.append(texts.doc[1:] != texts.doc[:-1], True), last, after) if len(texts.doc) else after[:0]
        np.add.at(change, texts.start[gone], 1)
        np.add.at(change, after[gone], -1)
        stay = np.cumsum(change[:-1], dtype=np.int8) == 0
        data = texts.data
    bounds = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(stay, out=bounds[1:])
    return data[stay], bounds[texts.offsets]


def _exchange(docs: DataFrame, key: str, text: str, width: int, seed: int, block_bytes: int):
    """Documents grouped by block, and what each block must know of the others, grouped alike."""
    if not 1 <= seed <= width:
        raise ValueError("a seed has 1 to width words")
    (block,) = fresh(docs, "block")
    dealt = docs.withColumn(block, block_of(blocks_for(docs, text, block_bytes), key, text))
    seeds = dealt.groupBy(block).applyInArrow(_list_seeds(key, text, width, seed), "seed long, block int")
    shared = (
        seeds.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("seed"))).where("n > 1").select("seed", "block")
    )
    listed = dealt.groupBy(block).cogroup(shared.groupBy("block")).applyInArrow(
        _list_windows(key, text, width, seed), "one long, two long, key long, block int, place int")
    sources = (
        listed.withColumn("source", F.min("key").over(Window.partitionBy("one", "two")))
        .where("source < key").select("place", "source", "block")
    )
    return dealt, dealt.groupBy(block).cogroup(sources.groupBy("block"))


def duplicate_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The factors: ``key, first_word, words, source``, a row for each. Factors of a document may overlap."""
    def run(group: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        parts = []
        for low, _, _, (doc, begin, length, source) in _parsed(table, shared, key, text, width):
            parts.append(pa.table({"key": table[key].take(pa.array(doc + low)).combine_chunks(), "first_word": begin, "words": length, "source": source}))
        return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], pa.int64()) for c in ("key", "first_word", "words", "source")})

    _, grouped = _exchange(docs.select(key, text), key, text, width, seed, block_bytes)
    return grouped.applyInArrow(run, "key long, first_word long, words long, source long")


def remove_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same rows with duplicate spans cut out of the text, white space between kept words unchanged,
    and ``n_words`` and ``n_removed`` added (with an underscore where such a column is there)."""
    total, cut = fresh(docs, "n_words", "n_removed")
    schema = StructType([*docs.schema.fields]).add(total, "long").add(cut, "long")
    names = docs.columns

    def run(group: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        texts_out, counts, removed = [], [], []
        for low, high, texts, found in _parsed(table, shared, key, text, width):
            gone = _removed(texts, found)
            data, bounds = _kept_bytes(texts, gone, spaced=False)
            texts_out += [data[a:b].tobytes().decode("utf-8") for a, b in zip(bounds[:-1], bounds[1:])]
            counts.append(texts.count)
            removed.append(np.diff(np.append(0, np.cumsum(gone))[texts.first]))
        valid = table[text].is_valid().to_pylist()
        new = pa.array([t if v else None for t, v in zip(texts_out, valid)], pa.string())
        out = {c: new if c == text else table[c] for c in names}
        return pa.table({**out, total: np.concatenate(counts), cut: np.concatenate(removed)})

    dealt, grouped = _exchange(docs, key, text, width, seed, block_bytes)
    return grouped.applyInArrow(_whole(run, names, total, cut), schema)


def _whole(run, names, total, cut):
    """Blocks without documents have nothing to return."""
    def guarded(group: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return pa.table({**{c: table[c] for c in names}, total: pa.array([], pa.int64()), cut: pa.array([], pa.int64())})
        return run(group, table, shared)
    return guarded


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the SHA-256 of the kept words joined by one space."""
    def run(group: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        counts, removed, sums = [], [], []
        for _, _, texts, found in _parsed(table, shared, key, text, width):
            gone = _removed(texts, found)
            data, bounds = _kept_bytes(texts, gone, spaced=True)
            sums += [hashlib.sha256(data[a:b].tobytes().rstrip(b" ")).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
            counts.append(texts.count)
            removed.append(np.diff(np.append(0, np.cumsum(gone))[texts.first]))
        empty = np.zeros(0, dtype=np.int64)
        return pa.table({
            "doc_id": table[key], "n_words": np.concatenate([empty, *counts]), "n_removed": np.concatenate([empty, *removed]),
            "kept_sha256": pa.array(sums, pa.string())})

    _, grouped = _exchange(docs.select(key, text), key, text, width, seed, block_bytes)
    return grouped.applyInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
