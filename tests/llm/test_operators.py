"""The operators on odd rows, against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from rows import KEYED, LONG, ODD, PASSAGE
from pyspark.sql import functions as F

import brute
from quillbar.llm import (
    chat, checksums, licenses, maxent, mixing, ngram_join, packing, quality_rules, records, substring_dedup, topk,
)
from quillbar.llm.components import components, stars
from quillbar.llm.words import Texts, slices, windows

TEXTS = [(r[0], r[1]) for r in ODD]
KEYED_TEXTS = [(i, t) for i, t in TEXTS if i is not None]
BIG = 10**18


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


# ---- words ---------------------------------------------------------------------------------

def test_words_are_those_of_the_pattern():
    texts = [t for _, t in TEXTS]
    for limit in (1, 100, 1 << 30):
        found = []
        for _, _, part in slices(pa.array(texts), limit):
            raw = part.data.tobytes()
            for d in range(len(part.offsets) - 1):
                found.append([raw[a:b].decode() for a, b in zip(part.start[part.first[d]:part.first[d + 1]], part.end[part.first[d]:part.first[d + 1]])])
        assert found == [brute.words(t) for t in texts]


def test_equal_words_and_windows_have_equal_hashes_wherever_they_stand():
    _, _, part = next(slices(pa.array(["x a b c", "", "a b c y a b"])))
    h = part.hashes()
    assert h[1] == h[4] == h[8] and len(set(h.tolist())) == 5
    w = windows(h, 2)
    assert w[1] == w[4] == w[8] and part.inside(2).tolist() == [True, True, True, False, True, True, True, True, True]
    assert len(windows(h, 99)) == 0 and len(Texts(np.zeros(0, np.uint8), np.array([0, 0])).hashes()) == 0


# ---- 1 -------------------------------------------------------------------------------------

@pytest.mark.parametrize("block_bytes", [1 << 23, 1 << 10])
def test_substring_digests(odd, block_bytes):
    got = substring_dedup.digests(odd, block_bytes=block_bytes).collect()
    assert ordered(tuple(r) for r in got) == ordered(brute.substring(TEXTS))


def test_substring_spans_have_a_source_that_holds_them(odd):
    texts = dict(TEXTS)
    spans = substring_dedup.duplicate_spans(odd).collect()
    assert {r["key"] for r in spans} >= {1, 9, 17, 18, None}
    for r in (r for r in spans if r["key"] is not None):
        own = brute.words(texts[r["key"]])[r["first_word"]:r["first_word"] + r["words"]]
        source = brute.words(texts[r["source"]])
        assert r["words"] >= 13 and any(source[i:i + len(own)] == own for i in range(len(source)))


def test_substring_texts_keep_their_white_space(clashing, none):
    out = substring_dedup.remove_duplicates(clashing)
    assert out.columns == [*clashing.columns, "n_words_", "n_removed_"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] == "Another start more text after it" and rows[1]["n_removed_"] == 30
    assert rows[12]["text"] == "line one here\nline one here\n\nline one here\r\nlast" and rows[2]["text"] is None
    assert rows[9]["text"] == "tail" and out.count() == len(ODD)
    assert substring_dedup.remove_duplicates(none).count() == substring_dedup.duplicate_spans(none).count() == 0


# ---- 2 -------------------------------------------------------------------------------------

@pytest.mark.parametrize("cell", [1024, 1])
def test_jaccard_components(odd, cell):
    got = {(r["key"], r["n_shingles"], r["component_id"]) for r in ngram_join.joined(odd, cell_limit=cell).collect() if r["key"] is not None}
    assert got == set(brute.jaccard_components(KEYED_TEXTS))


def test_jaccard_join_of_many_near_copies(spark):
    """Chains of copies that differ more and more, at all set sizes, with a common boilerplate."""
    rng = np.random.default_rng(5)
    rows = []
    for base in range(24):
        words = [f"v{x}" for x in rng.integers(0, 5000, int(rng.integers(5, 900)))]
        if base % 3 == 0:
            words = words[:40] + PASSAGE.split()
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), " ".join(words)))
            for _ in range(int(rng.integers(1, 3 + len(words) // 60))):
                words[int(rng.integers(0, len(words)))] = f"new{rng.integers(0, 10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(brute.jaccard_components(rows))
    assert sum(c != d for d, _, c in want) > 20
    for cell, values in ((1024, 1 << 21), (4, 1 << 21), (1024, 600)):
        assert {(r["key"], r["n_shingles"], r["component_id"]) for r in ngram_join.joined(df, cell_limit=cell, values=values).collect()} == want


def test_points_never_part_linked_sets():
    """The bound on points is at least the overlap, whatever number of groups each set's point has."""
    rng = np.random.default_rng(7)
    base = rng.integers(1, 2**62, 900, dtype=np.uint64)
    texts = [base[:n] for n in (900, 880, 800, 760)] + [rng.integers(1, 2**62, 850, dtype=np.uint64), base[:40]]
    sizes = np.array([len(np.unique(t)) for t in texts])
    groups = ngram_join._groups_of(sizes)
    assert groups.tolist() == [ngram_join.groups_for(n) for n in sizes.tolist()] and len(set(groups.tolist())) == 1
    wide = [np.bincount((ngram_join.mix(np.unique(t)) & np.uint64(k - 1)).astype(np.int64), minlength=k).astype("<u4") for t, k in zip(texts, (64, 128, 256, 64, 64, 512))]
    counts = ngram_join._folded(pa.chunked_array([pa.array([w.tobytes() for w in wide], pa.binary())]))
    assert counts.shape == (6, 64) and counts.sum(axis=1).tolist() == sizes.tolist()
    label = ngram_join.near_points(counts, sizes, 85)
    assert len(set(label[:4].tolist())) == 1 and label[5] == 5


def test_blocks_are_bounded_by_sets_and_shingles(spark):
    heads = spark.range(400).selectExpr("id % 2 as cell", "id as a", "id as b", "if(id < 390, 10 + id % 7, 5000 + id) as n")
    rows = ngram_join.tasks_of(heads, 85, 50, 20_000).collect()
    blocks = defaultdict(list)
    for r in rows:
        blocks[r["cell"], r["block"]].append(r["n"])
    assert len(rows) == 400 and max(map(len, blocks.values())) <= 50 and max(map(sum, blocks.values())) <= 20_000
    for r in rows:
        pairs = [tuple(p) for p in r["pairs"]]
        assert all(r["block"] in p for p in pairs) and (r["block"], r["block"]) in pairs
    met = {(x["cell"], tuple(p)) for x in rows for p in x["pairs"]}
    for x in rows:
        for y in rows:
            if x["cell"] == y["cell"] and x["n"] <= y["n"] and 100 * x["n"] >= 85 * y["n"]:
                assert (x["cell"], (min(x["block"], y["block"]), max(x["block"], y["block"]))) in met


def test_linked_sets_share_a_key_whatever_their_sizes():
    rng = np.random.default_rng(2)
    frequent = np.zeros(1 << ngram_join.SKETCH, dtype=np.uint8)
    for size in [6, 7, 20, 63, 64, 65, 75, 76, 130, 384, 385, 400, 577, 1153, 1300, 3000]:
        for grow in (0, 3 * size // 17):
            base = rng.integers(1, 2**62, size, dtype=np.uint64)
            swap = 0 if grow else size * 15 // 185
            other = np.concatenate([base[swap:], rng.integers(1, 2**62, grow + swap, dtype=np.uint64)])
            sets = ngram_join.Sets(Texts(np.zeros(0, np.uint8), np.zeros(3, np.int64)), 4)
            a, b = np.unique(base), np.unique(other)
            sets.hash, sets.doc = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            sets.first = np.array([0, len(a), len(a) + len(b)])
            sets.size = np.diff(sets.first)
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 85 * (len(a) + len(b) - shared):
                keys, doc = ngram_join.cell_keys(sets, 85, frequent)
                assert set(keys[doc == 0].tolist()) & set(keys[doc == 1].tolist()), (size, grow)


def test_enough_segments_are_filled_at_any_similarity():
    rng = np.random.default_rng(3)
    old = lambda n: np.ceil(np.log2(n / np.select([n <= 384, n <= 1152], [3.0, 4.5], 5.0))).astype(int)
    sizes = np.arange(65, 30_000)
    assert (ngram_join._level(sizes, 85) == old(sizes)).all()
    for percent in (80, 85, 90):
        level = ngram_join._level(sizes, percent)
        assert (np.diff(level) >= 0).all() and (level - ngram_join._level(-(-sizes * percent // 100), percent) <= 1)[sizes * percent > 6400].all()
        for n in [65, *(sizes[:-1][np.diff(level) > 0]).tolist()]:
            bits = int(ngram_join._level(np.array([n]), percent)[0])
            for _ in range(50):
                assert len(np.unique(rng.integers(0, 1 << bits, n))) > n * (100 - percent) // percent, (n, percent)


def test_one_of_each(odd, clashing, none):
    kept = [r["doc_id"] for r in ngram_join.one_of_each(clashing).collect()]
    want = {c for d, n, c in brute.jaccard_components(KEYED_TEXTS) if n} | {d for d, n, _ in brute.jaccard_components(KEYED_TEXTS) if not n}
    assert Counter(k for k in kept if k is not None) == Counter(want)
    assert ngram_join.one_of_each(clashing).columns == clashing.columns
    assert ngram_join.joined(none).count() == ngram_join.one_of_each(none).count() == 0


def test_texts_move_once_to_the_rows_that_stay(spark):
    """The kept rows are found by one shuffle of the texts; texts without a word stay without any."""
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(30))) for i in range(50)] + [(None, None), (60, ""), (61, " \t\n\x0b\x0c\r "), (61, ""), (62, "\x00"), (63, "\u00a0")]
    out = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(r for r in rows if r[0] != 63) + Counter([(63, "\u00a0")])
    initial = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    plan = [line for line in initial.splitlines() if "Exchange hashpartitioning" in line and "text_hash" in line]
    assert len(plan) == 2, initial  # the texts, and the rows they meet


def test_rows_of_one_key_in_several_components_all_stay(spark, odd):
    """Null keys and a repeated key, on texts that nothing links."""
    kept = [r["text"] for r in ngram_join.one_of_each(odd).collect() if r["doc_id"] is None]
    assert sorted(kept) == sorted(t for i, t in TEXTS if i is None) and len(kept) == 2
    rows = [(k, " ".join(f"{name}{i}" for i in range(40))) for k, name in [(None, "p"), (None, "q"), (None, "r"), (7, "x"), (7, "y"), (8, "y"), (None, "y"), (None, "r")]]
    found = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(rows[:5])


def test_a_chain_of_shared_passages_is_not_compared_as_one_cell(spark, monkeypatch):
    """Texts tied to the next by a passage, and few of them near copies: no block pairs of the whole chain, and the same components."""
    rng = np.random.default_rng(3)
    passages = [[f"p{i}w{x}" for x in rng.integers(0, 10**6, 24)] for i in range(121)]
    rows = [(i, " ".join(passages[i] + passages[i + 1])) for i in range(120)]
    rows += [(200 + i, rows[i][1].replace(passages[i][0], "other")) for i in range(0, 120, 9)]
    dealt = []

    def watched(heads, *more):
        dealt.append(max([r["count"] for r in heads.groupBy("cell").count().collect()], default=0))
        return real(heads, *more)

    real = ngram_join.tasks_of
    monkeypatch.setattr(ngram_join, "tasks_of", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(brute.jaccard_components(rows))
    assert sum(c != d for d, _, c in want) == 14
    assert {(r["key"], r["n_shingles"], r["component_id"]) for r in ngram_join.joined(df, cell_limit=8).collect()} == want
    assert dealt and max(dealt) <= 8, dealt


def test_points_of_one_key_are_all_compared():
    """Groups of all sizes, points of several widths: what ties is what the bound allows, within a group only."""
    rng = np.random.default_rng(11)
    base = rng.integers(1, 2**62, 1200, dtype=np.uint64)
    sets = [np.unique(base[:n]) if rng.random() < 0.7 else rng.integers(1, 2**62, n, dtype=np.uint64) for n in rng.integers(300, 1200, 160).tolist()]
    sizes = np.array([len(x) for x in sets])
    groups = ngram_join._groups_of(sizes)
    rows = [np.bincount((ngram_join.mix(x) & np.uint64(g - 1)).astype(np.int64), minlength=g).astype("<u4") for x, g in zip(sets, groups.tolist())]
    group = np.append(rng.integers(0, 40, 100), np.full(60, 99))
    one, other = ngram_join.near_groups(pa.chunked_array([pa.array([r.tobytes() for r in rows], pa.binary())]), sizes, group, 85)
    nodes, roots = stars(np.append(one, np.arange(160)), np.append(other, np.arange(160)))
    assert (group[one] == group[other]).all() and len(set(groups.tolist())) > 1
    for i in range(160):
        for j in range(160):
            if group[i] == group[j] and 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (sizes[i] + sizes[j]):
                assert roots[i] == roots[j], (i, j)
    far = [i for i in range(100) if all(group[i] != group[j] or 100 * min(sizes[i], sizes[j]) < 85 * max(sizes[i], sizes[j]) for j in range(160) if j != i)]
    assert far and all((roots == roots[i]).sum() == 1 for i in far)


def test_the_sieve_holds_all_its_keys(spark):
    keys = np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64)
    wanted = np.append(keys[:1000], np.array([0, 2**64 - 1], dtype=np.uint64))
    sieve = ngram_join.sieve_of(spark.createDataFrame([(x,) for x in wanted.view(np.int64).tolist()], "k long"))
    assert ngram_join._sieved(wanted, sieve).all() and ngram_join._sieved(keys[1000:], sieve).mean() < 0.05


def test_tree_leaves_out_no_partner():
    rng = np.random.default_rng(0)
    points = rng.poisson(5, (300, 64)).astype(np.int32)
    points[150:] = np.maximum(points[:150] + rng.integers(-1, 2, (150, 64)) * (rng.random((150, 64)) < 0.05), 0)
    sizes = points.sum(axis=1)
    tree = ngram_join.RTree(points, sizes)
    for i in range(300):
        near = set(tree.near(points[i], int(sizes[i]), 85).tolist())
        bound = np.minimum(points, points[i]).sum(axis=1)
        must = np.flatnonzero((185 * bound >= 85 * (sizes + sizes[i])) & (100 * sizes >= 85 * sizes[i]) & (100 * sizes[i] >= 85 * sizes))
        assert set(must.tolist()) <= near


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 7), (None, 1), (1, 2)], "x long, y long")
    groups = defaultdict(set)
    for r in components(links, "x", "y").collect():
        groups[r["root"]].add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4], [7], [8, 9]]
    assert components(links.limit(0), "x", "y").count() == 0


# ---- 3 -------------------------------------------------------------------------------------

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_counts(odd, clashing, none):
    rows = quality_rules.judged(odd).collect()
    assert ordered(tuple(r[c] for c in BASE) for r in rows) == ordered(brute.quality_base(TEXTS))
    assert not any(r["kept"] for r in rows if r["base_failed"])
    out = quality_rules.judged(clashing)
    assert out.columns[:len(clashing.columns)] == clashing.columns and out.columns[-1] == "kept_" and out.count() == len(ODD)
    assert quality_rules.judged(none).count() == 0


def test_quality_keeps_clean_documents_and_drops_junk(spark):
    """Against the labels of the test tables, which the rules never see."""
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in quality_rules.judged(spark.read.parquet(f"{folder}/documents.parquet")).collect() if r["doc_id"] in labels]
    clean = [r["kept"] for r in rows if labels[r["doc_id"]] and not r["base_failed"]]
    junk = [r["kept"] for r in rows if not labels[r["doc_id"]]]
    assert len(clean) > 300 and sum(clean) >= 0.99 * len(clean)
    assert len(junk) > 40 and sum(junk) <= 0.1 * len(junk)


def test_estimate_finds_the_better_rules():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.85
    right = np.array([0.97, 0.9, 0.8])
    votes = np.where(rng.random((20_000, 3)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = quality_rules.estimate(patterns, counts)
    assert ((posterior[inverse.ravel()] >= 0.5) == good).mean() > 0.96
    assert len(quality_rules.estimate(np.zeros((0, 3)), np.zeros(0))) == 0


# ---- 4 -------------------------------------------------------------------------------------

def top_k_brute(rows, k=10):
    usable = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
              if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q is not None and q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket,block", [(8192, 2048), (50, 3)])
def test_top_k(spark, bucket, block):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(1201, 8)) * np.exp(rng.normal(size=(1201, 1)) * 1.5)
    m[100:400] = m[5]
    m[7] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows[3], rows[200], rows[9], rows[11] = (3, None), (200, [1.0, None]), (9, [float("nan")] * 8), (11, [float("inf")] * 8)
    rows += [(5000, []), (6000, [1.0, 2.0]), (6001, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("norm", F.lit(1)).withColumn("id", F.lit(0))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 100 == 0, bucket=bucket, query_block=block).collect())
    assert got == top_k_brute(rows)
    assert topk.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_top_k_of_large_components(spark):
    """Products of any size: exact within a long, at its limit beyond."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=(600, 5)) * 10.0 ** rng.integers(0, 16, size=(600, 1))
    m[0], m[1], m[2], m[100] = 300_000, 1e300, -1e300, 1e13
    m[200:240] = m[300]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    top = 2**63 - 1
    exact = {i: [max(-top - 1, min(top, math.floor(1024 * x) if abs(x) < 1e290 else int(math.copysign(top + 1, x)))) for x in v] for i, v in rows}
    want = []
    for q in range(0, 600, 100):
        scores = sorted((-max(-top, min(top, sum(a * b for a, b in zip(exact[q], w)))), i) for i, w in exact.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for bucket in (8192, 40):
        got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 100 == 0, bucket=bucket).collect())
        assert got == want


# ---- 5 and 10 ------------------------------------------------------------------------------

def test_checksums():
    assert hex(checksums.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0, 9]))[0]) == "0xe3069283"

    def slow(data):
        state = 0xFFFFFFFF
        for byte in data:
            state ^= byte
            for _ in range(8):
                state = (state >> 1) ^ (checksums.POLYNOMIAL if state & 1 else 0)
        return state ^ 0xFFFFFFFF
    lengths = [0, 1, 63, 64, 65, 129, 0, 1000, 4097]
    data = np.random.default_rng(1).integers(0, 256, sum(lengths)).astype(np.uint8)
    bounds = np.append(0, np.cumsum(lengths))
    assert [slow(data[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])] == checksums.crc32c(data, bounds).tolist()


def test_records(spark, odd, none, tmp_path):
    got = [tuple(r) for r in records.round_trip(spark, odd, folder=f"file://{tmp_path}/r").collect()]
    assert ordered(got) == ordered(brute.record_rows(TEXTS))
    assert records.round_trip(spark, none, folder=f"file://{tmp_path}/e").count() == 0


def test_record_files_are_framed_and_damage_is_noticed(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/r"
    files = records.write_records(odd, folder, id_bytes=4)
    total = 0
    for path in sorted(tmp_path.glob("r/*.data")):
        raw, at = path.read_bytes(), 0
        while at < len(raw):
            size = int.from_bytes(raw[at:at + 8], "little")
            frame = np.frombuffer(raw[at:at + 8] + raw[at + 12:at + 12 + size], np.uint8)
            crcs = checksums.masked(checksums.crc32c(frame, np.array([0, 8, 8 + size])))
            assert [int(c) for c in crcs] == [int.from_bytes(raw[at + 8:at + 12], "little"), int.from_bytes(raw[at + 12 + size:at + 16 + size], "little")]
            at, total = at + 16 + size, total + 1
    assert total == len(ODD)
    path = max(tmp_path.glob("r/*.data"), key=lambda p: p.stat().st_size)
    raw = bytearray(path.read_bytes())
    raw[len(raw) // 2] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception, match="checksum"):
        records.read_records(files, folder, id_bytes=4).collect()


def test_packing(odd, none):
    rows = packing.pack(odd).collect()
    assert ordered((r["key"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == ordered(brute.piece_rows(TEXTS))
    bad, used = brute.packing_faults([(r["sequence_id"], r["offset"], r["length"]) for r in rows])
    assert not bad and used <= sum(r["length"] for r in rows) / 2048 + 1
    assert packing.pack(none).count() == packing.sequences(none).count() == 0


def test_packed_ids_are_those_of_the_documents(odd):
    ids = dict(brute.encoded(KEYED_TEXTS, 0))
    for r in packing.sequences(odd).collect():
        assert len(r["ids"]) == 4 * r["length"] <= 4 * 2048
        found = np.frombuffer(r["ids"], "<u4")
        for p in r["parts"]:
            if p["key"] is not None:
                assert found[p["offset"]:p["offset"] + p["length"]].tolist() == ids[p["key"]][p["piece"] * 2048:p["piece"] * 2048 + p["length"]]


def test_bins_close_the_fullest_first_and_stay_within_their_number():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (7, 6, 5, 4, 3, 10)] == [(0, 0), (1, 0), (2, 0), (1, 6), (2, 5), (3, 0)]
    rng = np.random.default_rng(0)
    bins, held = packing.OpenBins(100, 5), Counter()
    for n in rng.integers(1, 101, 3000).tolist():
        at, offset = bins.put(n)
        assert offset == held[at]
        held[at] += n
        assert held[at] <= 100 and bins.open <= 5 and bins.mask == sum(1 << f for f, b in enumerate(bins.by_free) if b)


# ---- 6 -------------------------------------------------------------------------------------

def test_license_scan(spark, none):
    mit = licenses.NOTICES["MIT"][1]
    fewer = mit.split()
    fewer[2] = "kindly"
    gpl = licenses.NOTICES["GPL-3.0"][0]
    rows = [(1, f"code first\n{mit}\nmore"), (2, " ".join(fewer)), (3, "Permission is hereby granted to all"), (4, None), (5, ""), (6, LONG),
            (7, f"{LONG} {gpl.upper()} {LONG}"), (8, f"{gpl} {PASSAGE} {gpl}"), (None, "x. Released under the MIT license!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))
    got = licenses.scan(df, licenses.notices(spark)).collect()
    assert {(r["key"], r["license"]) for r in got} == {(1, "MIT"), (2, "MIT"), (7, "GPL-3.0"), (8, "GPL-3.0"), (None, "MIT")}
    assert [r["first_word"] for r in got if r["key"] == 7] == [20_000] and [r["first_word"] for r in got if r["key"] == 1] == [2]
    assert sorted(r["first_word"] for r in got if r["key"] == 8) == [0, 42]
    assert licenses.scan(none, licenses.notices(spark)).count() == licenses.scan(df, licenses.notices(spark).limit(0)).count() == 0


def test_bands_find_what_containment_alone_would(spark):
    """Against all windows, without bands."""
    rng = np.random.default_rng(3)
    names, classes = licenses.prepared(licenses.notices(spark).collect(), 0.8, 0.999)
    notices = [t.split() for ts in licenses.NOTICES.values() for t in ts]
    found = missed = 0
    for _ in range(150):
        words = list(notices[int(rng.integers(0, len(notices)))])
        if rng.random() < 0.5:
            words[int(rng.integers(0, len(words)))] = "changed"
        text = " ".join([f"f{x}" for x in rng.integers(0, 99, 20)] + words + [f"g{x}" for x in rng.integers(0, 99, 20)])
        part = licenses.plain(next(slices(pa.array([text])))[2])
        held = {n for c in classes for n, wanted in c.sets.items()
                if np.isin(wanted, licenses._shingles(part, c.span)[0]).mean() >= 0.8}
        got = {n for _, n, *_ in licenses.matches(next(slices(pa.array([text])))[2], classes, 0.8)}
        assert got <= held
        found, missed = found + len(held & got), missed + len(held - got)
    assert found > 80 and missed <= found * 0.01


# ---- 7 -------------------------------------------------------------------------------------

def test_chat(spark):
    log = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"), (2, 2, "user", "bye"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "bye"),
        (4, 5, "user", "hi"), (5, None, None, None), (6, 0, "user", "<|im_end|> x"), (None, 0, "user", "lost"), (7, 0, "userhi", ""),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("x"))
    got = {r["conv"]: (r["n_turns"], r["text"]) for r in chat.rendered(df).collect()}
    assert set(got) == {2, 5, 6, 7, None}
    assert got[2] == (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n")
    assert got[5] == (1, "<|im_start|>\n<|im_end|>\n") and got[6][1].count("<|im_end|>") == 1
    assert chat.rendered(df.limit(0)).count() == 0
    plan = chat.rendered(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 8 -------------------------------------------------------------------------------------

def targets_brute(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = [s for s in order if s not in capped]
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if target[s] > 3 * sizes[s]}
        if not over:
            return target | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("block_rows,many", [(8192, False), (3, True)])
def test_mixing(spark, odd, block_rows, many):
    df, rows = odd, ODD
    if many:
        rng = np.random.default_rng(8)
        rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), "en", ["hot", "a", "b", None][min(3, int(rng.exponential(0.8)))], 1) for i in range(3000)]
        df = spark.createDataFrame(rows, odd.schema)
    got = mixing.taken(df, block_rows=block_rows).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    want, took, largest = targets_brute(sizes), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 3
        took[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(took[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(df.repartition(5), block_rows=block_rows).collect()))


def test_mixed_rows(clashing, none):
    taken = Counter()
    for r in mixing.taken(clashing).collect():
        taken[r["key"]] += r["copies"]
    rows = mixing.mixed(clashing)
    assert rows.columns == clashing.columns
    assert Counter(r["doc_id"] for r in rows.collect()) == +taken
    assert mixing.mixed(none).count() == mixing.taken(none).count() == 0


def test_mixed_repeated_rows(spark):
    """Rows of one key and text, with columns that differ in some of them, are rounded one by one."""
    rows = [(1, "w " * 100, "a", i % 3) for i in range(40)] + [(2, "v " * 10, "a", 0)] * 20 + [(3, "u " * 50, "b", 0)] * 7
    rows += [(4, "x " * 35, "b", None), (None, "y " * 20, "c", 1), (None, "y " * 20, "c", 1), (5, " ", "c", 1), (5, " ", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(brute.words(text))
    want, largest = targets_brute(sizes), {"a": 100, "b": 50, "c": 20}
    got = mixing.taken(df, block_rows=2)
    assert got.count() == len(rows)
    took, copies = Counter(), Counter()
    for r in got.collect():
        took[r["source"]] += r["copies"] * r["size"]
        copies[r["key"], r["size"]] += r["copies"]
        assert 0 <= r["copies"] <= 3
    assert all(abs(took[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)
    mixed = mixing.mixed(df, block_rows=2).collect()
    assert Counter((r["doc_id"], len(brute.words(r["text"]))) for r in mixed) == +copies
    each, before = Counter(tuple(r) for r in mixed), Counter(rows)
    assert all(n <= 3 * before[r] for r, n in each.items())
    again = mixing.mixed(df.repartition(4), block_rows=2).collect()
    assert Counter(tuple(r) for r in again) == each


def test_pivot_keeps_words_and_expectations():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 100, 200)
    chance = np.full(200, 0.3)
    taken = np.zeros(200)
    for _ in range(400):
        out, held = mixing.pivot(chance, size, rng.random(200))
        assert (out * size).sum() == pytest.approx((chance * size).sum()) and ((out == 0) | (out == 1)).sum() >= 199
        taken += out
    assert abs(taken.mean() / 400 - 0.3) < 0.02 and abs(taken / 400 - 0.3).max() < 0.15


# ---- 9 -------------------------------------------------------------------------------------

def test_base_scores(spark, none):
    df = spark.createDataFrame([r[:2] for r in KEYED], "doc_id long, text string").withColumn("held", F.lit("x")).withColumn("block", F.lit(1))
    got = sorted(tuple(r) for r in maxent.scores(df, block_bytes=1 << 12).collect())
    want = sorted(brute.base_scores([r[:2] for r in KEYED]))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] < 0
    assert maxent.scores(none).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in maxent.scores(only).collect())


def test_the_model_predicts_held_out_text_better_than_its_word_counts(spark, sf_dir):
    rows = [r for r in maxent.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.985 * sum(r["base_score"] for r in rows)


def test_a_rare_word_is_predicted_by_the_word_before(spark):
    """Endings and counts are the same for all followers, so that only the history tells them apart."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        pairs = rng.integers(0, 200, 20)
        rows.append((i, " ".join(f"head{p} tail{p}xyz" for p in pairs)))
    other = [(i, " ".join(f"head{a} tail{b}xyz" for a, b in rng.integers(0, 200, (20, 2)))) for i in range(3000, 3200)
             if zlib.crc32(str(i).encode()) % 10 == 0]
    got = {r["key"]: r for r in maxent.scores(spark.createDataFrame(rows + other, "doc_id long, text string").coalesce(1)).collect()}
    seen = [r["score"] for k, r in got.items() if k < 3000 and r["held_out"]]
    mixed = [got[i]["score"] for i, _ in other]
    # 20 followers a text, each of them more probable after its own head
    assert np.mean(seen) > np.mean(mixed) + 20 * 0.3


def test_word_rows_grow_with_the_corpus(spark):
    sizes = [maxent.buckets_for(n) for n in (0, 1e6, 1e8, 5e9)]
    assert sizes[0] == maxent.BUCKETS and sizes == sorted(sizes) and sizes[-1] >= 5e9 ** 0.5
    assert all(n & (n - 1) == 0 for n in sizes)
    _, _, part = next(slices(pa.array([LONG])))
    stream = maxent.Stream(part, np.zeros(0, np.uint64))
    used = [len(np.unique(stream.features(n)[0])) for n in (maxent.BUCKETS, 1 << 17)]
    assert used[1] > 2 * used[0] and stream.features(1 << 17).max() < 2 * maxent.PAIRS + (1 << 17)


def test_frequent_words_are_those_of_the_largest_counts(spark, monkeypatch):
    """Thousands of words that are frequent in one place each do not hide one that is met a little everywhere."""
    seen = []
    start = maxent.start
    monkeypatch.setattr(maxent, "start", lambda tokens, shares: seen.append((tokens, shares)) or start(tokens, shares))
    rows = [(i, " ".join([f"w{i}x{k}" for k in range(50)] * 3 + ["rare"] * 2 + [f"often{k}" for k in range(40) if i % (k + 1) == 0])) for i in range(400)]
    maxent.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), block_bytes=1 << 12)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in t.split())
    tokens, shares = seen[0]
    assert sorted(tokens[1:32]) == sorted(c for _, c in counts.most_common(31))
    assert tokens[0] == len(train) and tokens.sum() == len(train) + sum(counts.values()) and shares.min() >= 0


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    twice = docs.unionByName(docs.withColumn("doc_id", docs["doc_id"] % 3))
    one = sorted(tuple(r) for r in maxent.scores(twice.coalesce(1)).collect())
    assert sorted(tuple(r) for r in maxent.scores(twice.repartition(8)).collect()) == one
    # many trainers, added up by a tree of several levels
    monkeypatch.setattr(maxent, "TRAINER_SHARE", 5e-4)
    many = sorted(tuple(r) for r in maxent.scores(twice.repartition(5)).collect())
    assert many == sorted(tuple(r) for r in maxent.scores(twice.coalesce(1)).collect())
    assert [r[:6] for r in many] == [r[:6] for r in one] and [r[6] for r in many] != [r[6] for r in one]


def test_sums_by_feature_are_those_of_the_rows():
    rng = np.random.default_rng(3)
    for n in (1, 5, 700, 8192):
        values = rng.normal(size=(n, maxent.CLASSES)).astype(np.float32)
        for feature in (np.full(n, 9), rng.integers(0, 3, n), rng.integers(7, 9000, n), rng.zipf(1.3, n) % 200_000):
            rows, count, sums = maxent.sums_by_feature(feature.astype(np.int32), values)
            want = {int(f): np.flatnonzero(feature == f) for f in rows}
            assert len(set(rows.tolist())) == len(rows) == len(np.unique(feature)) and count.tolist() == [len(x) for x in want.values()]
            assert all((s == values[x].sum(axis=0, dtype=float)).all() for s, x in zip(sums, want.values()))


def test_a_step_sums_a_batch_without_a_number_for_each_place_of_it(monkeypatch):
    """Positions and sums in double precision for every token and class took most of the time of training."""
    rng = np.random.default_rng(5)
    trainer = maxent.Trainer(np.zeros((5000, maxent.CLASSES), dtype=np.float32))
    features, cls = rng.integers(0, 5000, (3, maxent.BATCH)).astype(np.int32), rng.integers(0, maxent.CLASSES, maxent.BATCH)
    sizes, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **b: sizes.append(len(x)) or bincount(x, *a, **b))
    trainer.learn(features, cls)
    assert max(sizes, default=0) <= maxent.BATCH
    assert trainer.seen.sum() == 3 * maxent.BATCH and abs(trainer.weights).max() <= 3 * maxent.RATE


def test_far_logits_leave_probabilities():
    rng = np.random.default_rng(6)
    features = rng.integers(0, 100, (3, 50)).astype(np.int32)
    for scale in (1, 60, 1000):
        weights = (rng.normal(size=(100, maxent.CLASSES)) * scale).astype(np.float32)
        logits = weights[features].astype(float).sum(axis=0)
        want = np.exp(logits - logits.max(axis=1, keepdims=True))
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(maxent.probabilities(weights, features), want, atol=1e-3 if scale > 60 else 1e-4)


def test_probabilities_sum_to_one():
    _, _, part = next(slices(pa.array(["a b c d", "x", None])))
    stream = maxent.Stream(part, np.zeros(0, np.uint64))
    weights = np.random.default_rng(0).normal(size=(maxent.FEATURES, maxent.CLASSES)).astype(np.float32)
    assert np.allclose(maxent.probabilities(weights, stream.features()).sum(axis=1), 1, atol=1e-5)
    assert stream.cls[[4, 6, 7]].tolist() == [0, 0, 0] and stream.count.tolist() == [5, 2, 1]
