"""The published valence rules on the published example sentences, and rule by rule."""

import math

import pytest

from quillbar.operators import valence

# Ratings of the words in the published examples (fixed values).
RATINGS = {
    "smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "great": 3.1, "bad": -2.5, "horrible": -2.5, "sux": -1.5, "lol": 1.8,
    "uncompelling": -0.9, "sure": 1.3, ":)": 2.0, ":d": 2.3, "no": -1.2, "die": -2.9,
}
# Published sentences and their compound scores (fixed values).
PUBLISHED = [
    ("VADER is smart, handsome, and funny.", 0.8316),
    ("VADER is smart, handsome, and funny!", 0.8439),
    ("VADER is very smart, handsome, and funny.", 0.8545),
    ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342),
    ("VADER is not smart, handsome, nor funny.", -0.7424),
    ("The book was good.", 0.4404),
    ("At least it isn't a horrible book.", 0.431),
    ("The book was only kind of good.", 0.3832),
    ("The plot was good, but the characters are uncompelling and the dialog is not great.", -0.7042),
    ("Today SUX!", -0.5461),
    ("Today only kinda sux! But I'll get by, lol", 0.5249),
    ("Make sure you :) or :D today!", 0.8633),
    ("Not bad at all", 0.431),
]


@pytest.fixture(scope="module")
def ratings(spark):
    return spark.createDataFrame(list(RATINGS.items()), "token string, valence double")


def scored(spark, ratings, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = {r["id"]: r for r in valence.valence_rules(df, "id", "text", ratings, **options).collect()}
    return [rows[i] for i in range(len(texts))]


def test_published_sentences(spark, ratings):
    got = scored(spark, ratings, [t for t, _ in PUBLISHED])
    for (text, want), r in zip(PUBLISHED, got):
        assert r["compound"] == pytest.approx(want, abs=6e-5), text
        assert r["p_negative"] + r["p_neutral"] + r["p_positive"] == pytest.approx(1)
    assert [round(got[0][p], 3) for p in ("p_negative", "p_neutral", "p_positive")] == [0.0, 0.254, 0.746]


def squash(s):
    return s / math.sqrt(s * s + 15)


RULES = [
    ("never so good", 1.9 * 1.25 + 0.293 * 1.25, "so lifts the word, never so lifts both"),
    ("without doubt good", 1.9, "no negation"), ("without any good", 1.9 * -0.74, ""),
    ("the least good", 1.9 * -0.74, ""), ("at least good", 1.9, ""),
    ("no good", 1.9 * -0.74, "the word no itself counts nothing before a rated word"),
    ("we said no", -1.2, ""), ("a meal to die for", 3.0, "an idiom sets the word in it"), ("sort of good", 1.9, "too near the start for phrases"),
    ("it was sort of good", 1.9 - 0.293, ""), ("it was the bomb good", 3.0, "an idiom just before the word"),
    ("good?", 1.9, ""), ("good??", 1.9 + 0.36, ""), ("good?????", 1.9 + 0.96, ""), ("good!!!!!!", 1.9 + 4 * 0.292, ""),
    ("GOOD", 1.9, "all in capitals is no emphasis"), ("it is GOOD", 1.9 + 0.733, ""), ("EXTREMELY good stuff", 1.9 + 0.293 + 0.733, ""),
    ("", 0.0, ""), ("   ", 0.0, ""), (None, 0.0, ""), ("but good", 1.9 * 1.5, ""), ("good but", 1.9 * 0.5, ""),
]


def test_rule_by_rule(spark, ratings):
    for (text, want, why), r in zip(RULES, scored(spark, ratings, [t for t, _, _ in RULES])):
        assert r["compound"] == pytest.approx(squash(want)), (text, why)
    assert scored(spark, ratings, [None])[0]["p_neutral"] == 1.0


def test_large_lexicon_gives_the_same_without_a_broadcast(spark, ratings):
    texts = [t for t, _ in PUBLISHED]
    for a, b in zip(scored(spark, ratings, texts, most_rows=3), scored(spark, ratings, texts)):
        assert a["compound"] == pytest.approx(b["compound"]) and a["y_pred"] == b["y_pred"]


def test_no_word_moves(spark, ratings):
    df = spark.range(5).selectExpr("id", "'a good day' as text")
    plan = valence.valence_rules(df, "id", "text", ratings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "hashpartitioning(token" not in plan and "SortMergeJoin" not in plan


def test_only_words_of_the_lexicon_become_rows(spark, ratings):
    df = spark.createDataFrame([(1, "plain words only " * 500 + "not GOOD but bad"), (2, "nothing"), (3, None)], "id long, text string")
    rows = valence._layout(df, "id", "text", [], ["good", "bad"]).collect()
    assert [(r["id"], r["token"], r["b1"], r["turn"], r["_count"]) for r in rows] == [
        (1, "good", "not", 0.5, 1504), (1, "bad", "but", 1.5, 0), (2, None, None, None, 1), (3, None, None, None, 0)]
    every = valence._layout(df, "id", "text", []).collect()
    assert len(every) == 1506 and sum(r["_count"] or 0 for r in every) == 1505
    repeated = valence.valence_rules(df.union(df), "id", "text", ratings)
    whole = valence.valence_rules(df.union(df), "id", "text", ratings, most_rows=3)
    for a, b in zip(repeated.orderBy("id").collect(), whole.orderBy("id").collect()):
        assert a["p_neutral"] == pytest.approx(b["p_neutral"]) and a["compound"] == pytest.approx(b["compound"])
