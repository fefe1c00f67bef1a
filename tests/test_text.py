import random
import re

import pytest
from pyspark.sql import functions as F

from quillbar.functions import text as tx
from quillbar.operators import lemmas, summary


def run(spark, expression, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    out = [r[0] for r in rows.orderBy("i").select(expression(F.col("t"))).collect()]
    return out if len(values) > 1 else out[0]


@pytest.mark.parametrize("raw, cleaned", [
    ("COPPER Futures Slip?", "copper futures slip?"),
    ("The filing at https://filings.test/q3?page=2 has the numbers", "the filing at has the numbers"),
    ("A sober note from @desk_seven", "a sober note from"),
    ("see HTTP://A.b/c?d=%20#frag end", "see #frag end"),
    ("mail a@b now", "mail now"), ("x @y z", "x z"), ("@a@b c", "c"), ("a@ b", "a@ b"),
    ("call 555-123-4567 or 5551234567", "call or"), ("id 15551234567", "id 15551234567"),
    ("#tag stays", "#tag stays"), ("by @élodie today", "by today"),
    ("  a  b\n\tc  ", "a b c"), ("", ""), (None, ""),
])
def test_clean_text(spark, raw, cleaned):
    assert run(spark, tx.clean_text, raw) == cleaned


def test_clean_options(spark):
    raw = "A #tag @name https://x.y"
    assert run(spark, lambda t: tx.clean_text(t, remove_hashtags=True), raw) == "a"
    assert run(spark, lambda t: tx.clean_text(t, remove_urls=False, remove_mentions=False), raw) == "a #tag @name https://x.y"


def plain_clean(text):
    """The same steps with another regex engine."""
    text = text.lower()
    for pattern in (r"https?://[a-zA-Z!$-_]+", r"\S+@\S+", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"@\w+"):
        text = re.sub(pattern, "", text)
    return re.sub(r"\s+", " ", text).strip()


def test_clean_text_on_random_strings(spark):
    rng = random.Random(11)
    parts = ["a", "B", "é", "ß", "1", "555", "-", ".", "@", "#", " ", "\n", " ", " ", "\x1c", "https://", "http://x", "%", "$", "_", "日", "١"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    assert run(spark, tx.clean_text, *texts) == [plain_clean(t) for t in texts]


def test_long_words_do_not_hurt(spark):
    texts = ["x" * 200_000, "https://" + "a" * 200_000, "a-" * 100_000, "@" * 100_000, "1," * 100_000, "a.b@" * 30_000]
    cleaned = run(spark, tx.clean_text, *texts)
    assert cleaned[0] == texts[0] and cleaned[1] == ""
    assert len(run(spark, tx.tokenize, *texts)[2]) == 2
    assert run(spark, lambda t: tx.entity_flags(t)["has_percentage"], *texts) == [False] * 6


def test_tokens(spark):
    assert run(spark, tx.tokenize, "don't stop: it's $1,250.50 (up 12.5%)...") == [
        "do", "n't", "stop", ":", "it", "'s", "$", "1,250.50", "(", "up", "12.5", "%", ")", "..."]
    assert run(spark, tx.tokenize, "well-known state--owned co.") == ["well-known", "state", "--", "owned", "co", "."]
    assert run(spark, tx.tokenize, None) == [] and run(spark, tx.tokenize, "  ") == []


def test_stop_words_keep_finance_terms(spark):
    out = run(spark, lambda t: tx.remove_stopwords(F.split(t, " "), ["the", "stock", "is"]), "the stock is up")
    assert out == ["stock", "up"]
    assert run(spark, lambda t: tx.preprocess_text(t), "The market is NOT closed by @x") == "market closed"


def test_languages(spark):
    for language in ("english", "french", "german", "spanish"):
        assert len(tx.stop_words(language)) > 100


LEMMA_ROWS = ["stocks buses boxes churches women parties wolves gas as mice glass it's"]


def dictionaries(spark):
    exceptions = spark.createDataFrame([("mice", "mouse"), ("o'\\s", "x")], "surface string, lemma string")
    vocabulary = spark.createDataFrame([(w,) for w in "stock bus box church woman party wolf gas a glass it's".split()], "lemma string")
    return exceptions, vocabulary


def test_lemmas(spark):
    df = spark.createDataFrame([(1, LEMMA_ROWS[0].split()), (2, []), (3, ["unknowns"])], "id long, tokens array<string>")
    out = lemmas.lemmatize(df, "tokens", *dictionaries(spark), ["id"])
    got = {r["id"]: r["lemmas"] for r in out.collect()}
    assert got[1] == "stock bus box church woman party wolf gas a mouse glass it's".split()
    assert got[2] == [] and got[3] == ["unknowns"]


def test_a_surface_form_listed_twice_has_its_first_lemma(spark):
    df = spark.createDataFrame([(1, ["axes", "saw", "plain"])], "id long, tokens array<string>")
    twice = spark.createDataFrame([("axes", "axis"), ("axes", "ax"), ("saw", "see"), ("saw", "saw")], "surface string, lemma string")
    large = spark.range(30_000).selectExpr("concat('w', id) as surface", "concat('v', id) as lemma").union(twice)
    vocabulary = spark.range(30_000).selectExpr("concat('v', id) as lemma")
    for exceptions in (twice, large):
        assert lemmas.lemmatize(df, "tokens", exceptions, vocabulary, ["id"]).first()["lemmas"] == ["ax", "saw", "plain"]


def test_short_dictionaries_move_no_text(spark):
    rows = [(1, LEMMA_ROWS[0].split()), (1, ["mice", "o'\\s"]), (None, ["parties", None, "ies", "s", ""]), (2, None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    short = lemmas.lemmatize(df, "tokens", *dictionaries(spark), ["id"])
    assert "Exchange" not in short._jdf.queryExecution().executedPlan().toString()
    assert [r["lemmas"] for r in short.collect()] == [
        "stock bus box church woman party wolf gas a mouse glass it's".split(), ["mouse", "x"], ["party", None, "ies", "s", ""], None]
    assert lemmas.few_changes(*dictionaries(spark), most_words=5) is None
    # the words written out from the dictionaries are those that a look at the texts finds
    words = df.where("id = 1").selectExpr("explode(tokens) as token").distinct()
    found = {tuple(r) for r in lemmas.changed_words(words, *dictionaries(spark)).collect()}
    assert found and found <= set(lemmas.few_changes(*dictionaries(spark)))


def test_preprocess_all_steps(spark):
    df = spark.createDataFrame([(1, "ACME Stocks Rally! Read https://acme.example @desk")], "id long, headline string")
    out = lemmas.preprocess_lemmas(df, "headline", *dictionaries(spark), ["id"])
    assert out.first()["headline_processed"] == "acme stock rally ! read"
    assert summary.preprocess(df, "headline").columns[-1] == "headline_processed"
    assert summary.preprocess(df, "headline", "x").columns[-1] == "x"


def flags(spark, text, match="substring"):
    df = spark.createDataFrame([(text,)], "headline string")
    return {k for k, v in summary.add_entity_flags(df, match=match).first().asDict().items() if v is True}


def test_entity_flags(spark):
    assert flags(spark, "Acme posts $70M profit as spring earnings arrive") == {
        "has_earnings_keywords", "has_price_target", "has_dollar_amount"}
    assert flags(spark, "The second refined deal") == {"has_merger_keywords", "has_regulatory_keywords"}
    assert flags(spark, "The second refined deal", "word") == {"has_merger_keywords"}
    assert flags(spark, "up 3% and $ 5") == {"has_percentage"}
    assert flags(spark, None) == set()


def test_price_target_and_amount_agree(spark):
    for text in ("$5", "$5.00", "$1,000", "a$7b", "$.5", "US$ 9"):
        found = flags(spark, text)
        assert ("has_price_target" in found) == ("has_dollar_amount" in found) == bool(re.search(r"\$\d", text))


def test_shape(spark):
    df = spark.createDataFrame([(1, " two  words "), (2, ""), (3, "🙂 é")], "id int, headline string")
    got = [(r["text_length"], r["word_count"]) for r in summary.headline_shape(df).orderBy("id").collect()]
    assert got == [(len(" two  words "), 2), (0, 0), (3, 2)]


def test_stop_words_in_the_sql_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    from quillbar.functions.fixed_values import ENGLISH_STOP_WORDS

    assert [w for w in StopWordsRemover.loadDefaultStopWords("english") if w] == ENGLISH_STOP_WORDS


def test_sql_needs_no_files_of_the_spark_package(monkeypatch):
    import glob
    import zipfile

    from quillbar.plans import oracle

    monkeypatch.setattr(glob, "glob", lambda *a, **k: [])
    monkeypatch.setattr(zipfile, "ZipFile", None)
    assert len(oracle.statements()) > 90


def test_steps_and_language_of_the_preprocessing(spark):
    df = spark.createDataFrame([("Der Kurs und die Aktie steigt! https://a.example",)], "t string")

    def got(**options):
        return df.select(tx.preprocess_text(F.col("t"), **options)).first()[0]
    assert got(language="german") == "kurs aktie steigt !"
    assert got() == "der kurs und die aktie steigt !"
    assert got(steps=("clean",)) == "der kurs und die aktie steigt!"
    assert got(steps=("stopwords",), language="german") == "Der Kurs Aktie steigt! https://a.example"
    assert got(steps=()) == "Der Kurs und die Aktie steigt! https://a.example"
    with pytest.raises(ValueError):
        got(steps=("stem",))
