"""The Arrow scorer against plain sums, and exported models against the models they come from."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, strategies as st
from pyspark.ml.functions import vector_to_array

from quillbar.functions.fixed_values import LABELS
from quillbar.operators import features, lexicon, models, scoring
from quillbar.operators.scoring import LinearModel, score_lists, score_model, windows_of
from quillbar.plans import catalog
from quillbar.sources import inputs

MODEL = LinearModel(pa.array(["up", "down", "é"]), np.array([[-1.0, 0.0, 2.0], [1.5, 0.0, -1.0], [0.25, 0.5, 0.125]]), np.array([0.0, 0.5, 0.0]))


def by_hand(tokens):
    scores = MODEL.bias.copy()
    for t in tokens or []:
        if t in MODEL.words.to_pylist():
            scores = scores + MODEL.weights[MODEL.words.to_pylist().index(t)]
    raised = [math.exp(x - max(scores)) for x in scores]
    return [x / sum(raised) for x in raised]


@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["up", "down", "é", "zzz", ""]), max_size=30)), max_size=12),
       st.integers(1, 5), st.integers(1, 9))
def test_rows_are_scored_whole_in_any_batches(rows, batch_size, max_length):
    got = score_lists(pa.array(rows, pa.list_(pa.string())), MODEL, batch_size, max_length)
    assert got.shape == (len(rows), 3)
    for row, p in zip(rows, got.tolist()):
        assert p == pytest.approx(by_hand(row))


def test_windows_cover_every_token_once():
    row, first, size = windows_of(np.array([0, 5, 12, 4]), 5)
    assert row.tolist() == [1, 2, 2, 2, 3] and first.tolist() == [0, 5, 10, 15, 17] and size.tolist() == [5, 5, 5, 2, 4]


def test_batches_hold_windows_of_near_equal_length():
    """The padded matrices of a skewed batch hold hardly more places than there are tokens."""
    seen = []

    class Watched(LinearModel):
        def logits(self, ids):
            seen.append(ids.shape)
            return super().logits(ids)

    model = Watched(MODEL.words, MODEL.weights, MODEL.bias)
    rows = [["up"] * n for n in [1, 500, 2, 499, 3, 498, 2000] * 8]
    score_lists(pa.array(rows), model, 8, 512)
    assert all(b <= 8 and n <= 512 for b, n in seen)
    assert sum(b * n for b, n in seen) < 1.05 * sum(map(len, rows))


def test_too_large_a_model_is_refused(monkeypatch):
    monkeypatch.setattr(scoring, "MOST_WORDS", 2)
    with pytest.raises(ValueError, match="more than a worker"):
        LinearModel(MODEL.words, MODEL.weights, MODEL.bias)


def test_scores_of_a_table(spark):
    rows = [(0, "up up x"), (1, None), (2, "down, é!"), (None, "down"), (4, "up " * 3000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = score_model(df, "id", "text", MODEL, batch_size=2, max_length=7).collect()
    want = {0: ["up", "up"], 1: [], 2: ["down", "é"], None: ["down"], 4: ["up"] * 3000}
    assert len(got) == 5
    for r in got:
        p = by_hand(want[r["id"]])
        assert [r[c] for c in models.PROBABILITIES] == pytest.approx(p) and r["y_pred"] == LABELS[int(np.argmax(p))]
    assert score_model(df.where("false"), "id", "text", MODEL).count() == 0


@pytest.fixture(scope="module")
def tokens(spark, sf_dir):
    labelled = inputs.headlines(spark, sf_dir).select("headline_id", "headline").join(
        inputs.truth(spark, sf_dir).withColumnRenamed("row_id", "headline_id"), "headline_id")
    return lexicon.with_tokens(labelled, "headline_id", "headline", carry=["y_true"]).cache()


def test_exported_logistic_scores_like_the_fitted_one(spark, tokens):
    fitted = scoring.fit_word_logistic(tokens, "_tokens", "y_true", words=3000)
    model = LinearModel.of_logistic(fitted)
    assert len(model.words) <= 3000
    ours = {r["headline_id"]: r for r in score_model(tokens, "headline_id", "_tokens", model).collect()}
    for r in fitted.transform(tokens).select("headline_id", vector_to_array("_p").alias("p"), "_best").collect():
        mine = ours[r["headline_id"]]
        assert [mine[c] for c in models.PROBABILITIES] == pytest.approx(r["p"], abs=1e-9)
        assert mine["y_pred"] == LABELS[int(r["_best"])]


def test_exported_naive_bayes_scores_like_the_fitted_one(spark, tokens):
    fitted = models.NaiveBayes.fit(tokens.where("y_true <> 'neutral'"), "_tokens", "y_true")
    ours = {r["headline_id"]: r for r in score_model(tokens, "headline_id", "_tokens", LinearModel.of_naive_bayes(fitted)).collect()}
    for r in fitted.score(tokens, "headline_id", "_tokens").collect():
        mine = ours[r["headline_id"]]
        assert [mine[c] for c in models.PROBABILITIES] == pytest.approx([r[c] for c in models.PROBABILITIES], abs=1e-9)
        assert mine["p_neutral"] == 0.0 and mine["y_pred"] == r["y_pred"]


def test_a_model_of_more_words_than_a_worker_holds_is_split(spark, tokens, monkeypatch):
    """The whole model scores every row, repeated and null keys too, while no worker holds more than its frequent words."""
    train = tokens.where("y_true <> 'neutral'")
    odd = spark.createDataFrame([(None, ["surge", None, "nowhere"]), (None, []), (10**9, None)], "headline_id long, _tokens array<string>")
    rows = tokens.select("headline_id", "_tokens").unionByName(tokens.select("headline_id", "_tokens").limit(5)).unionByName(odd)
    fitted = models.NaiveBayes.fit(train, "_tokens", "y_true", broadcast_rows=300)
    words = fitted.words.count()
    assert words > 1000
    whole = LinearModel.of_naive_bayes(models.NaiveBayes.fit(train, "_tokens", "y_true"))
    want = sorted(map(str, [(r[0], r[1], [round(x, 9) + 0.0 for x in r[2:]]) for r in score_model(rows, "headline_id", "_tokens", whole).collect()]))
    monkeypatch.setattr(scoring, "MOST_WORDS", 300)
    split = LinearModel.of_naive_bayes(fitted)
    assert 0 < len(split.held.words) <= 300 and len(split.held.words) + split.rest.count() == words
    for model in (split, scoring.SplitModel(LinearModel(pa.array([], pa.string()), np.zeros((0, 3)), split.held.bias),
                                           fitted.words.select("token", *[fitted.words[f"l_{c}"].alias(s) for c, s in zip(LABELS, scoring.SUMS)]))):
        got = score_model(rows, "headline_id", "_tokens", model, batch_size=8, max_length=20).collect()
        assert sorted(map(str, [(r[0], r[1], [round(x, 9) + 0.0 for x in r[2:]]) for r in got])) == want


def test_feature_table_takes_a_model_of_any_size(spark, sf_dir, monkeypatch):
    """The query with a model that no worker may hold whole: the same rows."""
    query = catalog.REGISTRY["feature_table"]
    want = sorted(map(str, query(spark, sf_dir).collect()))
    monkeypatch.setattr(scoring, "MOST_WORDS", 300)
    monkeypatch.setattr(models.NaiveBayes.fit.__func__, "__defaults__", (1.0, 300))
    assert want and sorted(map(str, query(spark, sf_dir).collect())) == want


def test_feature_table_reads_texts_once_and_moves_no_token(spark, sf_dir):
    heads = inputs.headlines(spark, sf_dir)
    out = features.feature_table(heads, inputs.bars(spark, sf_dir), inputs.lexicon(spark), inputs.NEGATIONS, inputs.BOOSTERS)
    text = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert text.count("documents.parquet") == 1 and "hashpartitioning(token" not in text
    flat = lexicon.valence(heads, "headline_id", "headline", inputs.lexicon(spark), inputs.NEGATIONS, inputs.BOOSTERS)
    assert "hashpartitioning(token" not in flat._jdf.queryExecution().executedPlan().toString()
