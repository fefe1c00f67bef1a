"""Sentiment from word lists: polarity, subjectivity and rule-based valence.

These are this project's own definitions. Tokens are exploded next to their row, looked up in the
lexicon and summed per row before anything is shuffled, so what moves is one small record per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillbar.functions import fixed_values as fixed
from quillbar.functions.numeric import ratio
from quillbar.functions.text import clean_text, tokenize


LOOKUP_ROWS = 200_000
LOOKUP_BYTES = 8 << 20
IN_ROW_WORDS = 10_000


def lookup(table: DataFrame, most_rows: int = LOOKUP_ROWS, most_bytes: int = LOOKUP_BYTES) -> tuple[DataFrame, bool]:
    """The table, and whether it is small. A small one comes back as local rows.

    The planner does not know the size of rows that came from Python or from a shuffle, and would move every token of every
    text to meet them. So a table of up to ``most_rows`` rows and ``most_bytes`` bytes is fetched (never more than one row beyond
    the limit) and given back with its size known; a larger one stays where it is.
    """
    found = table.limit(most_rows + 1).toArrow()
    if found.num_rows > most_rows or found.nbytes > most_bytes:
        return table, False
    return table.sparkSession.createDataFrame(found, table.schema), True


def few_words(table: DataFrame, column: str = "token", most_words: int = IN_ROW_WORDS) -> list[str] | None:
    """The distinct words of a short list, which rows can look up by themselves; None for a longer one."""
    found = table.select(column).where(F.col(column).isNotNull()).limit(most_words + 1).toArrow()
    return None if found.num_rows > most_words else sorted(set(found.column(0).to_pylist()))


def hit_places(tokens: Column, words: Sequence[str]) -> Column:
    """The places of the tokens that are among the words."""
    return F.array_compact(F.transform(tokens, lambda t, i: F.when(t.isin(list(words)), i)))


def join_words(words: DataFrame, lexicon: DataFrame, most_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Look words up. A lexicon of checked size is broadcast, so that no word moves; with a larger one words meet by shuffle, and adaptive
    execution splits the frequent ones."""
    table, small = lookup(lexicon, most_rows)
    return words.join(F.broadcast(table) if small else table, "token", "left")


def with_tokens(df: DataFrame, key: str, text: str, into: str = "_tokens", carry: Sequence[str] = ()) -> DataFrame:
    """``key``, the columns to carry, and the tokens of the cleaned text; a column that holds tokens already is taken as it is.

    Explode the tokens with ``explode_outer``: a plain ``explode`` makes the planner test each
    array for being empty before that, which tokenizes every text twice.
    """
    ready = df.schema[text].dataType.typeName() == "array"
    return df.select(key, *carry, (F.col(text) if ready else tokenize(clean_text(F.col(text)))).alias(into))


def label_by_cut(score: Column, cut: float = fixed.VALENCE_CUT) -> Column:
    return F.when(score > cut, "positive").when(score < -cut, "negative").otherwise("neutral")


def _word_hits(df: DataFrame, key: str, text: str, lexicon: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``key, token`` and the lexicon columns, one row per token; of a short lexicon only for tokens that are in it, or one without a token."""
    lexicon = lexicon.select("token", *columns)
    words, tokens = few_words(lexicon), F.col("_tokens")
    if words is not None:
        tokens = F.filter(tokens, lambda t: t.isin(words))
    return join_words(with_tokens(df, key, text).select(key, F.explode_outer(tokens).alias("token")), lexicon)


def _word_hits_in_context(df: DataFrame, key: str, text: str, lexicon: DataFrame, columns: Sequence[str],
                          negations: Sequence[str], boosters: dict[str, float], carry: Sequence[str] = ()) -> DataFrame:
    """``_word_hits`` with ``_v``, the word's valence after boosters and negations before it, and ``_count``, which sums up to the number of tokens.

    The three tokens before are taken from the row's own array: no window, no shuffle. With a short lexicon only tokens
    that are in it become rows; the first of them, or the one row without a token, counts all tokens of the text.
    """
    tokens = F.col("_tokens")
    lexicon = lexicon.select("token", *columns)
    words = few_words(lexicon)
    rows = with_tokens(df, key, text, carry=carry)

    def placed(t: Column, i: Column, count: Column) -> Column:
        return F.struct(
            t.alias("token"),
            F.when(i >= 1, F.get(tokens, i - 1)).alias("b1"),
            F.when(i >= 2, F.get(tokens, i - 2)).alias("b2"),
            F.when(i >= 3, F.get(tokens, i - 3)).alias("b3"),
            count.alias("_count"))

    if words is None:
        found = rows.select(key, *carry, F.inline_outer(F.transform(tokens, lambda t, i: placed(t, i, F.when(t.isNotNull(), 1).otherwise(0)))))
    else:
        found = rows.withColumns({"_places": hit_places(tokens, words), "_size": F.size(F.array_compact(tokens))}).select(
            key, *carry, "_size", F.inline_outer(F.transform("_places", lambda i, n: placed(F.get(tokens, i), i, F.when(n == 0, F.col("_size")).otherwise(0)))))
        found = found.withColumn("_count", F.coalesce("_count", "_size")).drop("_size")
    hits = join_words(found, lexicon)

    def boost(name: str, weight: float) -> Column:
        out = F.lit(0.0)
        for word, step in boosters.items():
            out = F.when(F.col(name) == word, step * weight).otherwise(out)
        return out

    value = F.col("valence")
    value = value + F.signum(value) * (boost("b1", 1.0) + boost("b2", 0.95) + boost("b3", 0.9))
    for name in ("b1", "b2", "b3"):
        value = value * F.when(F.col(name).isin(list(negations)), fixed.NEGATION_FACTOR).otherwise(1.0)
    return hits.withColumn("_v", value)


def _polarity_sums() -> list[Column]:
    found = F.count("polarity")
    return [
        F.coalesce(ratio(F.sum("polarity"), found), F.lit(0.0)).alias("polarity"),
        F.coalesce(ratio(F.sum("subjectivity"), found), F.lit(0.0)).alias("subjectivity"),
        found.alias("n_hits"),
    ]


def _valence_sums() -> list[Column]:
    v = F.col("_v")
    return [
        F.coalesce(F.sum(v), F.lit(0.0)).alias("_s"),
        F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("_up"),
        F.sum(F.when(v < 0, 1 - v).otherwise(0.0)).alias("_down"),
        (F.coalesce(F.sum("_count"), F.lit(0)) - F.count_if(v != 0)).cast("double").alias("_flat"),
    ]


def _with_compound(sums: DataFrame) -> DataFrame:
    total = F.col("_up") + F.col("_down") + F.col("_flat")
    return sums.withColumns({
        "compound": F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + fixed.VALENCE_ALPHA),
        "p_negative": F.coalesce(ratio(F.col("_down"), total), F.lit(0.0)),
        "p_neutral": F.coalesce(ratio(F.col("_flat"), total), F.lit(1.0)),
        "p_positive": F.coalesce(ratio(F.col("_up"), total), F.lit(0.0)),
    }).drop("_s", "_up", "_down", "_flat")


def polarity(df: DataFrame, key: str, text: str, lexicon: DataFrame, cut: float = fixed.VALENCE_CUT) -> DataFrame:
    """``key, polarity, subjectivity, n_hits, y_pred``: means over the words found, 0 if none.

    ``lexicon`` has ``token, polarity, subjectivity``, one row per token.
    """
    hits = _word_hits(df, key, text, lexicon, ["polarity", "subjectivity"])
    return hits.groupBy(key).agg(*_polarity_sums()).withColumn("y_pred", label_by_cut(F.col("polarity"), cut))


def valence(df: DataFrame, key: str, text: str, lexicon: DataFrame, negations: Sequence[str],
            boosters: dict[str, float], cut: float = fixed.VALENCE_CUT) -> DataFrame:
    """``key, compound, p_negative, p_neutral, p_positive, y_pred``.

    ``lexicon`` has ``token, valence`` (double), one row per token. A word's valence is moved by
    boosters and flipped by negations among the three tokens before it; boosters count 100, 95
    and 90 % by distance. Sums are squashed to (-1, 1). The three shares are of negative, neutral
    and positive words, as in the published rules.
    """
    hits = _word_hits_in_context(df, key, text, lexicon, ["valence"], negations, boosters)
    return _with_compound(hits.groupBy(key).agg(*_valence_sums())).withColumn(
        "y_pred", label_by_cut(F.col("compound"), cut))


def all_scores(df: DataFrame, key: str, text: str, lexicon: DataFrame, negations: Sequence[str],
               boosters: dict[str, float], carry: Sequence[str] = ()) -> DataFrame:
    """Polarity, subjectivity and valence from one pass over the texts; columns to carry hang on the key."""
    hits = _word_hits_in_context(df, key, text, lexicon, ["polarity", "subjectivity", "valence"], negations, boosters, carry)
    return _with_compound(hits.groupBy(key, *carry).agg(*_polarity_sums(), *_valence_sums()))
