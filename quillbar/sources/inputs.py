"""Inputs of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillbar.functions.fixed_values import KEYWORDS, LABELS
from quillbar.functions.text import clean_text, tokenize
from quillbar.operators.align import join_bars

TICKERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
KEYWORD_RING = KEYWORDS["positive"] + KEYWORDS["negative"] + KEYWORDS["neutral"]
SUFFIX_RING = [
    "", " See https://ex.com/a?b=1#x for more", " by @Trader", " up 12.5% today",
    " target $1,250.50", " call 555-123-4567", " mail a.b@c.com", " #bullish",
    " SEC   investigation", " merger deal", " Quarterly earnings of $100M", " not very good",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ring(values: list[str], index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per order priority and day."""
    price = F.col("o_totalprice")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"))
        .agg(
            F.round(100 + F.min_by("o_totalprice", "o_orderkey") / 50000, 2).alias("open"),
            F.round(100 + F.max(price) / 50000, 2).alias("high"),
            F.round(100 + F.min(price) / 50000, 2).alias("low"),
            F.round(100 + F.max_by("o_totalprice", "o_orderkey") / 50000, 2).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def bars_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and ship day: many symbols."""
    price = F.col("l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
                 F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.round(100 + F.min(price) / 50000, 2).alias("open"),
            F.round(100 + F.max(price) / 50000, 2).alias("high"),
            F.round(100 + F.min(price) / 50000, 2).alias("low"),
            F.round(100 + F.max(price) / 50000, 2).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One headline per document: symbol, keyword, the whole text, suffix."""
    doc = F.col("doc_id")
    symbol = _ring(TICKERS, doc % 5)
    return table(spark, sf_dir, "documents").select(
        doc.alias("headline_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), ((doc * 7) % 480).cast("int")).alias("date"),
        symbol.alias("symbol"),
        F.concat(symbol, F.lit(" stock "), _ring(KEYWORD_RING, (doc * 7) % 30), F.lit(" "),
                 F.col("text"), _ring(SUFFIX_RING, doc % 12)).alias("headline"),
        "lang",
        "source",
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
        .otherwise("neutral").alias("y_true"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic models over the labelled rows, with class probabilities."""
    row = F.col("row_id")
    models = F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("i"), F.lit(f"m{i}").alias("model")) for i in range(3)]))
    base = truth(spark, sf_dir).withColumn("_m", models).select("row_id", "y_true", "_m.i", "_m.model")
    i = F.col("i")
    turn = (row + i) % 3
    weighed = base.select(
        "model", "row_id", "y_true",
        F.when(row % (i + 2) == 0, F.col("y_true"))
        .when(turn == 0, "negative").when(turn == 1, "neutral").otherwise("positive").alias("y_pred"),
        (1 + (row * 3 + i * 5) % 7).alias("w0"),
        (1 + (row * 5 + i * 5) % 7).alias("w1"),
        (1 + (row * 2 + i * 5) % 7).alias("w2"),
    )
    total = F.col("w0") + F.col("w1") + F.col("w2")
    return weighed.select(
        "model", "row_id", "y_true", "y_pred",
        (F.col("w0") / total).alias("p_negative"),
        (F.col("w1") / total).alias("p_neutral"),
        (F.col("w2") / total).alias("p_positive"),
    )


# Word lists for the lexicon queries: token, polarity, subjectivity, valence.
LEXICON = [
    ("surge", 0.5, 0.5, 2.0), ("rally", 0.4, 0.5, 1.8), ("breakthrough", 0.6, 0.6, 2.4),
    ("outperform", 0.5, 0.4, 1.9), ("bullish", 0.6, 0.7, 2.2), ("growth", 0.3, 0.3, 1.6),
    ("profit", 0.4, 0.3, 1.9), ("revenue", 0.1, 0.2, 0.6), ("earnings", 0.1, 0.2, 0.5),
    ("beat", 0.3, 0.4, 1.1), ("upgrade", 0.4, 0.4, 1.7), ("good", 0.7, 0.6, 1.9),
    ("decline", -0.4, 0.4, -1.6), ("plunge", -0.6, 0.6, -2.2), ("crash", -0.8, 0.8, -2.8),
    ("bearish", -0.6, 0.7, -2.1), ("loss", -0.5, 0.4, -1.9), ("miss", -0.3, 0.4, -1.2),
    ("downgrade", -0.4, 0.4, -1.7), ("concern", -0.3, 0.5, -1.1), ("risk", -0.3, 0.5, -1.3),
    ("volatility", -0.2, 0.5, -0.9), ("investigation", -0.2, 0.4, -1.0), ("deal", 0.2, 0.3, 0.8),
]
NEGATIONS = ["not", "never", "no", "n't"]
BOOSTERS = {"very": 0.293, "most": 0.293, "slightly": -0.293}
REMARKS = [
    " It was a VERY good deal!!", " At least it isn't a loss, but a risk", " never so good, without doubt a growth", " Not bad... kind of a crash??",
    " the LEAST good profit", " no growth, no profit or good deal", " a deal to die for???? ", " GOOD! but NOT a breakthrough!!!!!",
    " somewhat bullish and EXTREMELY good :)", " the crash never was this bad", " slightly less of a decline", "",
]
# The lexicon of the full rules: that of above and some more words.
RULE_LEXICON = {**{t: v for t, _, _, v in LEXICON}, "bad": -2.5, "no": -1.2, ":)": 2.0, "die": -2.9}
# Irregular nouns: surface form, lemma.
LEMMA_EXCEPTIONS = [("children", "child"), ("feet", "foot"), ("mice", "mouse"), ("women", "woman")]
POSITIVE_WORDS = ["surge", "rally", "bullish", "growth", "profit"]
NEGATIVE_WORDS = ["crash", "plunge", "bearish", "loss", "risk"]


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "token string, polarity double, subjectivity double, valence double")


def rule_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULE_LEXICON.items()), "token string, valence double")


def remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines, some in capitals, each with a remark at its end."""
    key = F.col("headline_id")
    text = F.concat("headline", _ring(REMARKS, key % 12))
    return headlines(spark, sf_dir).select("headline_id", F.when(key % 40 == 7, F.upper(text)).otherwise(text).alias("headline"))


def lemma_exceptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEMMA_EXCEPTIONS, "surface string, lemma string")


def lemma_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tokens of the benchmark texts."""
    words = table(spark, sf_dir, "benchmark").select(F.explode_outer(tokenize(clean_text(F.col("text")))).alias("lemma"))
    return words.where("lemma is not null").distinct()


def evaluated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the date, symbol and close of their headline."""
    keys = headlines(spark, sf_dir).select(F.col("headline_id").alias("row_id"), "date", "symbol")
    market = join_bars(keys, bars(spark, sf_dir).select("date", "symbol", "close"))
    return predictions(spark, sf_dir).join(market, "row_id")


def bar_predictions(bar_table: DataFrame) -> DataFrame:
    """Bars with a predicted label that depends on the date."""
    turn = F.datediff("date", F.lit("1995-01-01").cast("date")) % 3
    return bar_table.withColumn(
        "y_pred", F.when(turn == 0, "negative").when(turn == 1, "neutral").otherwise("positive"))


def count_scorer():
    """A stand-in for a caller's model: probabilities from counts of a few words."""
    def score(texts):
        rows = []
        for text in texts:
            up = 1 + sum(text.count(w) for w in POSITIVE_WORDS)
            down = 1 + sum(text.count(w) for w in NEGATIVE_WORDS)
            total = up + down + 1
            rows.append((down / total, 1 / total, up / total))
        return rows

    return score


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: ``row_id, date, symbol, close``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderpriority").alias("symbol"), F.round(100 + F.col("o_totalprice") / 50000, 2).alias("close"))


def _moment(day, second):
    """A time stamp: a day and a second of it."""
    days = F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return F.timestamp_seconds(days * 86400 + second % 86400)


def timed_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: ``row_id, symbol, ts``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("symbol"), _moment("o_orderdate", F.col("o_orderkey")).alias("ts"))


def timed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per order line: ``point_id, symbol, ts, value``; a third and more are of the first symbol."""
    supplier, order, line = F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (order * 10 + line).alias("point_id"), F.when(supplier % 3 == 0, TICKERS[0]).otherwise(_ring(TICKERS, supplier % 5)).alias("symbol"),
        _moment("l_shipdate", order * 131 + line * 7).alias("ts"), F.col("l_discount").alias("value"))


def tick_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for every order, with probabilities that follow its price."""
    row, price = F.col("o_orderkey"), F.col("o_totalprice")
    w0, w1, w2 = 1 + price, 1 + (price * 7) % 100000, 1 + (price * 3) % 300000
    turn = (row % 3).cast("int")
    classes = F.array(*[F.lit(c) for c in LABELS])
    return table(spark, sf_dir, "orders").select(
        F.lit("all").alias("model"), row.alias("row_id"), F.get(classes, turn).alias("y_true"),
        F.get(classes, ((row * 5 + 1) % 3).cast("int")).alias("y_pred"),
        (w0 / (w0 + w1 + w2)).alias("p_negative"), (w1 / (w0 + w1 + w2)).alias("p_neutral"),
        (w2 / (w0 + w1 + w2)).alias("p_positive"))
