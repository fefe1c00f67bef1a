"""The pipeline and the registered queries."""

from collections import Counter

import brute
import corpus_pipeline
from rows import ODD

from quillbar.llm import ngram_join, quality_rules, queries, substring_dedup


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "ngram_jaccard_join", "substring_dedup", "source_mixing", "best_fit_packing"]
    assert [n for n in queries.REGISTRY] and {int(n[2:].split("_")[0]) for n in queries.REGISTRY} == set(range(1, 14))


def test_each_stage_keeps_the_columns_and_takes_effect(spark, odd, clashing, none, sf_dir):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), clashing, none):
        before = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, before, sf_dir).checkpoint()
            assert after.columns == docs.columns, name
            before = after
        assert set(corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in quality_rules.judged(docs).collect() if r["kept"]}
    first = {c for _, _, c in brute.jaccard_components(sorted(kept.items()), 5, 80)}
    texts = {i: t for i, t in kept.items() if i in first}
    cut = {i: (n - gone, digest) for i, n, gone, digest in brute.substring(sorted(texts.items()))}
    stage = dict(corpus_pipeline.STAGES)
    after = docs
    for name in ("quality_rules", "ngram_jaccard_join", "substring_dedup"):
        after = stage[name](spark, after, sf_dir).checkpoint()
    import hashlib
    got = {r["doc_id"]: (len(brute.words(r["text"])), hashlib.sha256(" ".join(brute.words(r["text"])).encode()).hexdigest()) for r in after.collect()}
    assert got == cut
    mixed = stage["source_mixing"](spark, after, sf_dir).checkpoint()
    assert {r["doc_id"] for r in mixed.collect()} <= {i for i, (n, _) in cut.items() if n}
    packed = stage["best_fit_packing"](spark, mixed, sf_dir).collect()
    want = brute.piece_rows([(r["doc_id"], r["text"]) for r in mixed.collect()])
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == Counter(want)
    bad, used = brute.packing_faults([(r["sequence_id"], r["offset"], r["length"]) for r in packed])
    assert not bad and used <= sum(r["length"] for r in packed) / 2048 * 1.02 + 1


def test_nothing_is_lost_that_has_no_copy(odd):
    assert len(ODD) == quality_rules.judged(odd).count() == substring_dedup.remove_duplicates(odd).count()
    assert ngram_join.joined(odd).count() == len(ODD)


def test_near_copies_are_those_of_five_words_and_four_fifths(spark, sf_dir):
    rows = []
    for base, size in enumerate([30, 60, 64, 80, 130, 300, 400, 880, 1200, 3000]):
        words = [f"w{base}x{i}" for i in range(size)]
        # more text at the end (similarity about 0.83 and 0.78), and scattered edits of about 2 and 3 % of the words
        for more in ([], [f"more{base}x{i}" for i in range(size // 5)], [f"other{base}x{i}" for i in range(size * 2 // 7)]):
            rows.append((len(rows), " ".join(words + more)))
        for step in (48, 30):
            rows.append((len(rows), " ".join(f"new{step}" if i % step == step // 2 else w for i, w in enumerate(words))))
    want = {c for _, _, c in brute.jaccard_components(rows, 5, 80)}
    assert want != {c for _, _, c in brute.jaccard_components(rows)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, sf_dir).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(want)
