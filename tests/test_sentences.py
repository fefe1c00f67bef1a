"""Sentence ends and tokens with learned abbreviations."""

import pytest

from quillbar.operators import sentences

FILLER = [
    "On friday the firm fell. We saw the market stop early", "They stop on monday. The firm said so", "A market may rise again. They sell on friday",
    "Early gains may stop. On monday we buy again", "It was early on friday", "So we may buy the firm on monday",
    "It fell and they sell at the end of the year",
]
PRAISED = "Dr. Young met Acme Inc. on Monday. He cannot stop! It isn't over"


@pytest.fixture(scope="module")
def texts():
    rows = [(i, FILLER[i % len(FILLER)]) for i in range(280)]
    rows += [(1000 + i, f"Dr. Young and dr. Hale led Acme Inc. again and Bolt Inc. too, number {i}") for i in range(40)]
    rows += [(2000, PRAISED), (2001, "Quote (by dr. Hale). \"Over?\" They left... Then it fell"), (2002, "J. Hale will buy it. The firm is Acme Inc."),
             (2003, None), (2004, ""), (2005, " \t "), (2006, "..."), (2007, "word " * 20_000 + "end. The last"), (2008, "Gonna buy Bolt Inc. They sell.")]
    return rows


@pytest.mark.parametrize("most_rows", [200_000, 0])
def test_sentences_and_abbreviations(spark, texts, most_rows):
    df = spark.createDataFrame(texts, "id long, text string").repartition(3).selectExpr("id", "text", "1 as base", "2 as w")
    got = {r["id"]: r["sentences"] for r in sentences.tokenize_sentences(df, "text", ["id"], most_rows=most_rows).collect()}
    assert len(got) == len(texts)
    assert got[0] == [["On", "friday", "the", "firm", "fell", "."], ["We", "saw", "the", "market", "stop", "early"]]
    assert got[2000] == [
        ["Dr.", "Young", "met", "Acme", "Inc.", "on", "Monday", "."], ["He", "can", "not", "stop", "!"], ["It", "is", "n't", "over"]]
    assert got[2001] == [["Quote", "(", "by", "dr.", "Hale", ")", "."], ['"', "Over", "?", '"'], ["They", "left", "...", "Then", "it", "fell"]]
    assert got[2002] == [["J.", "Hale", "will", "buy", "it", "."], ["The", "firm", "is", "Acme", "Inc", "."]]
    assert got[2003] == got[2004] == got[2005] == [] and got[2006] == [["..."]]
    assert len(got[2007]) == 2 and len(got[2007][0]) == 20_002
    # "they" is a known starter, so that the abbreviation ends its sentence
    assert got[2008] == [["Gon", "na", "buy", "Bolt", "Inc", "."], ["They", "sell", "."]]


def test_learned_words(spark, texts):
    df = spark.createDataFrame(texts, "id long, text string").select("id", sentences._parts("text").alias("_parts"))
    types = sentences.word_types(df)
    assert {r["base"] for r in sentences.abbreviations(types).collect()} == {"dr", "inc", "j"}
    found = {r["base"]: r for r in types.collect()}
    assert found["dr"]["n"] == found["dr"]["dotted"] == 82 and found["acme"]["inside"] == 42 and found["young"]["inside"] == 0 and found["the"]["small"] >= 80
    assert sentences.tokenize_sentences(spark.createDataFrame([], "id long, text string"), "text", ["id"]).count() == 0


def test_words_do_not_move_to_meet_abbreviations(spark, texts):
    df = spark.createDataFrame(texts, "id long, text string")
    plan = sentences.tokenize_sentences(df, "text", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(base" not in plan and "hashpartitioning(next" not in plan


def test_texts_meet_their_records_and_not_all_that_is_known_of_their_words(spark, texts):
    df = spark.createDataFrame(texts, "id long, text string")
    plan = sentences.tokenize_sentences(df, "text", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftOuter" in line and "_row" in line)
    below = plan[plan.index(join) + len(join):].split("Aggregate")[0]
    assert "text#" in below and "_parts#" not in below and "regexp_extract_all" not in below


def test_null_keys_and_words_beyond_ascii(spark, texts):
    more = [(3000, "\u00c4rzte met dr. \u00d6zil (\u00e4 \u2160.) and Inc. too"), (3001, "Gonna go. CANNOT stop dr. Hale now"), (None, "Dr. Hale fell. It rose")]
    df = spark.createDataFrame(texts[:320] + more, "id long, text string")
    got = [r["sentences"] for r in sentences.tokenize_sentences(df, "text", ["id"]).where("id >= 3000 or id is null").collect()]
    assert [["Dr.", "Hale", "fell", "."], ["It", "rose"]] in got
    # a short word that is seen once, with a period, counts as an abbreviation
    assert [["Gon", "na", "go.", "CAN", "NOT", "stop", "dr.", "Hale", "now"]] in got
