import math

import pytest
from pyspark.sql import functions as F

from quillbar.functions.fixed_values import LABELS
from quillbar.operators import lexicon, models
from quillbar.sources import inputs

TEXTS = [("Great earnings report", "positive"), ("Terrible market performance", "negative"),
         ("Neutral market conditions", "neutral"), ("Strong growth prospects", "positive"), ("Declining revenue", "negative")]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(TEXTS)], "id long, text string, label string")


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


@pytest.fixture(scope="module")
def words(spark):
    return inputs.lexicon(spark)


def test_polarity(spark, words):
    df = texts(spark, "Good growth, no deal", "nothing here", None, "crash!")
    got = {r["id"]: r for r in lexicon.polarity(df, "id", "text", words).collect()}
    assert got[0]["polarity"] == pytest.approx((0.7 + 0.3 + 0.2) / 3) and got[0]["n_hits"] == 3 and got[0]["y_pred"] == "positive"
    assert got[1]["polarity"] == got[2]["polarity"] == 0.0 and got[1]["y_pred"] == "neutral"
    assert got[3]["y_pred"] == "negative" and got[3]["subjectivity"] == pytest.approx(0.8)


def test_small_lexicon_is_broadcast_and_a_large_one_is_not(spark, words):
    tokens = spark.createDataFrame([("good",), ("x",)], "token string")
    small, large = lexicon.join_words(tokens, words), lexicon.join_words(tokens, words, most_rows=3)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (small, large)]
    assert "BroadcastHashJoin" in plans[0] and "Exchange hashpartitioning" not in plans[0] and "BroadcastHashJoin" not in plans[1]
    assert sorted(small.collect()) == sorted(large.collect()) and small.count() == 2


def test_only_words_of_a_short_lexicon_become_rows(spark, words):
    df = texts(spark, "plain " * 300 + "not good, a loss", "", None, "nothing")
    hits = lexicon._word_hits_in_context(df, "id", "text", words, ["valence"], inputs.NEGATIONS, inputs.BOOSTERS).collect()
    assert sorted((r["id"], r["token"] or "", r["b1"], r["_count"]) for r in hits) == [
        (0, "good", "not", 305), (0, "loss", "a", 0), (1, "", None, 0), (2, "", None, 0), (3, "", None, 1)]
    assert lexicon._word_hits(df, "id", "text", words, ["polarity"]).count() == 5
    assert lexicon.few_words(words, most_words=3) is None


def valence(spark, words, *values):
    out = lexicon.valence(texts(spark, *values), "id", "text", words, inputs.NEGATIONS, inputs.BOOSTERS)
    return [out.where(F.col("id") == i).first() for i in range(len(values))]


def test_valence_rules(spark, words):
    def squash(s):
        return s / math.sqrt(s * s + 15)
    plain, very, negated, far, twice, both, none = valence(
        spark, words, "good", "very good", "not good", "not a b c good", "very x good", "not very good", "zzz")
    assert plain["compound"] == pytest.approx(squash(1.9))
    assert very["compound"] == pytest.approx(squash(1.9 + 0.293))
    assert negated["compound"] == pytest.approx(squash(1.9 * -0.74)) and negated["y_pred"] == "negative"
    assert far["compound"] == pytest.approx(squash(1.9))
    assert twice["compound"] == pytest.approx(squash(1.9 + 0.293 * 0.95))
    assert both["compound"] == pytest.approx(squash((1.9 + 0.293) * -0.74))
    assert none["compound"] == 0.0 and none["y_pred"] == "neutral" and none["p_neutral"] == 1.0
    for r in (plain, very, negated, both, none):
        assert r["p_negative"] + r["p_neutral"] + r["p_positive"] == pytest.approx(1)


def test_naive_bayes_by_hand(spark, train):
    got = {r["id"]: r for r in models.NaiveBayes.fit(train, "text", "label").score(texts(spark, "growth revenue zzz", ""), "id", "text").collect()}
    vocabulary, size = 13, {"negative": 5, "neutral": 3, "positive": 6}
    prior = {"negative": 2 / 5, "neutral": 1 / 5, "positive": 2 / 5}
    def score(c, hits):
        return math.log(prior[c]) + sum(math.log((h + 1) / (size[c] + vocabulary)) for h in hits)
    assert got[0]["score_positive"] == pytest.approx(score("positive", [1, 0]))
    assert got[0]["score_negative"] == pytest.approx(score("negative", [0, 1]))
    assert got[0]["score_neutral"] == pytest.approx(score("neutral", [0, 0]))
    assert sum(got[0][p] for p in models.PROBABILITIES) == pytest.approx(1)
    assert got[1]["y_pred"] == "negative" and got[1]["p_neutral"] == pytest.approx(0.2)


@pytest.mark.parametrize("limit", [1, 4])
def test_naive_bayes_with_a_large_vocabulary(spark, train, limit):
    df = texts(spark, "market growth market revenue", "unknown", "great market")
    small = models.NaiveBayes.fit(train, "text", "label")
    large = models.NaiveBayes.fit(train, "text", "label", broadcast_rows=limit)
    assert large.hot_words is not None and large.hot_words.count() <= limit
    a, b = (sorted(m.score(df, "id", "text").collect()) for m in (small, large))
    for x, y in zip(a, b):
        assert [v if isinstance(v, str) else pytest.approx(v) for v in x] == list(y)


def test_naive_bayes_moves_only_rare_words(spark, train, monkeypatch):
    written = []
    monkeypatch.setattr(models, "materialize", lambda df: written.append(df) or df)
    df = texts(spark, *["market " * 50 + "growth"] * 20, "strange")
    fitted = models.NaiveBayes.fit(train.union(train.where("label = 'positive'")), "text", "label", broadcast_rows=12)
    assert 4 < fitted.hot_words.count() <= 12
    hot = {r["token"] for r in fitted.hot_words.collect()}
    fitted.score(df, "id", "text").collect()
    moved = [r["token"] for r in written[-1].collect() if r["token"] is not None]
    assert "_n" in written[-1].columns and "strange" in moved and not hot & set(moved) and len(moved) <= 21


def test_missing_class_never_wins(spark, train):
    fitted = models.NaiveBayes.fit(train.where("label != 'neutral'"), "text", "label")
    got = fitted.score(texts(spark, "market"), "id", "text").first()
    assert got["p_neutral"] == 0.0 and got["y_pred"] in ("negative", "positive")


def test_logistic(spark, train):
    fitted = models.fit_logistic(train, "text", "label", features=1 << 10)
    got = models.score_logistic(fitted, texts(spark, "Excellent quarterly results", "growth prospects"), "id").collect()
    assert all(r["y_pred"] in LABELS and abs(sum(r[p] for p in models.PROBABILITIES) - 1) < 1e-6 for r in got)


def votes(spark, *rows):
    data = [(m, i, p, *q) for i, row in enumerate(rows) for m, (p, q) in enumerate(row)]
    return spark.createDataFrame(data, "model int, row_id int, y_pred string, " + ", ".join(f"{p} double" for p in models.PROBABILITIES))


def test_ensembles(spark):
    df = votes(spark, [("positive", (0.1, 0.2, 0.7)), ("neutral", (0.3, 0.4, 0.3)), ("positive", (0.8, 0.1, 0.1))],
               [("positive", (0.2, 0.2, 0.6)), ("negative", (0.6, 0.2, 0.2)), ("neutral", (0.2, 0.6, 0.2))])
    assert [r["y_pred"] for r in models.ensemble_vote(df).orderBy("row_id").collect()] == ["positive", "negative"]
    mean = models.ensemble_mean(df).orderBy("row_id").collect()
    assert [r["y_pred"] for r in mean] == ["negative", "negative"] and mean[0]["p_negative"] == pytest.approx(0.4)


def test_majority_and_random(spark, train):
    df = texts(spark, *["x"] * 300)
    assert {r["y_pred"] for r in models.baseline_majority(train, df, "id", "label").collect()} == {"negative"}
    a = models.baseline_random(df, "id").collect()
    assert sorted(a) == sorted(models.baseline_random(df.repartition(7), "id").collect())
    assert {r["y_pred"] for r in a} == set(LABELS) and a != models.baseline_random(df, "id", 1).collect()


def test_plug_in_scorer(spark):
    df = texts(spark, "surge", "crash", None)
    def load():
        def score(batch):
            assert len(batch) <= 2
            return [(0.1, 0.2, 0.7) if "surge" in t else (0.8, 0.1, 0.1) for t in batch]
        return score
    got = models.plug_in_scorer(df.coalesce(1), "id", "text", load, batch_size=2).orderBy("id").collect()
    assert [r["y_pred"] for r in got] == ["positive", "negative", "negative"] and got[0]["p_positive"] == 0.7
