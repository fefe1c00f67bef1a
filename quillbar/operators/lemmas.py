"""Lemmas from dictionary tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillbar.functions.fixed_values import NOUN_ENDINGS
from quillbar.functions.text import preprocess_tokens
from quillbar.operators.lexicon import IN_ROW_WORDS, lookup
from quillbar.session import materialize


def lemmatize(df: DataFrame, tokens: str, exceptions: DataFrame, vocabulary: DataFrame, key: Sequence[str],
              into: str = "lemmas") -> DataFrame:
    """Add noun lemmas of the token column.

    The words that short dictionaries can change at all are few: they are written out from the dictionaries, without a look at the texts,
    and each row changes its own tokens. ``exceptions`` has ``surface, lemma``; ``vocabulary`` has ``lemma``. Larger dictionaries, of any size, are joined with the
    distinct tokens of the table, and only words that change travel back to the rows: by broadcast if they are few, else by
    shuffle. A surface form listed more than once has the alphabetically first of its lemmas. ``key`` identifies a row.
    """
    key = list(key)
    few = few_changes(exceptions, vocabulary)
    if few is not None:
        return df.withColumn(into, F.transform(tokens, lambda t: _changed(t, few)))
    # three branches read the tokens: made once, written once, without the texts
    settled = materialize(df.select(*key, F.col(tokens).alias("_words")))
    pairs = settled.select(*key, F.explode(F.array_distinct("_words")).alias("token"))
    changes = materialize(changed_words(pairs.select("token").distinct(), exceptions, vocabulary))
    table, small = lookup(changes)
    per_row = (
        pairs.join(F.broadcast(table) if small else table, "token")
        .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("_changes"))
    )
    lemmas = settled.join(per_row, key, "left").withColumn(
        into, F.transform("_words", lambda t: F.coalesce(F.element_at("_changes", t), t))).drop("_changes")
    if set(df.columns) <= {*key, tokens}:
        return lemmas.withColumnRenamed("_words", tokens)
    rows = lemmas.select(F.struct(*key).alias("_row"), into)
    return df.withColumn("_row", F.struct(*key)).join(rows, "_row", "left").drop("_row")


def preprocess_lemmas(df: DataFrame, text: str, exceptions: DataFrame, vocabulary: DataFrame, key: Sequence[str],
                      into: str | None = None, words: Sequence[str] | None = None, join: bool = True, **options) -> DataFrame:
    """All steps: clean, tokenize, drop stop words, lemmatize, and join by spaces unless ``join`` is off.
    ``options`` are those of ``preprocess_tokens``."""
    into = into or f"{text}_processed"
    if few_changes(exceptions, vocabulary) is not None:
        out = lemmatize(df.withColumn("_tokens", preprocess_tokens(F.col(text), words, **options)), "_tokens", exceptions, vocabulary, key, into)
        return (out.withColumn(into, F.array_join(into, " ")) if join else out).drop("_tokens")
    tokens = df.select(*key, preprocess_tokens(F.col(text), words, **options).alias("_tokens"))
    out = lemmatize(tokens, "_tokens", exceptions, vocabulary, key, into)
    rows = out.select(F.struct(*key).alias("_row"), F.array_join(into, " ").alias(into) if join else into)
    return df.withColumn("_row", F.struct(*key)).join(rows, "_row", "left").drop("_row")


def changed_words(words: DataFrame, exceptions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``token, lemma`` for the distinct words whose lemma differs from the word."""
    token = F.col("token")
    forms = [F.struct(F.lit(0).alias("i"), token.alias("form"))]
    for i, (ending, replacement) in enumerate(NOUN_ENDINGS, start=1):
        stem = F.substring(token, F.lit(1), F.length(token) - len(ending))
        forms.append(F.when(F.endswith(token, F.lit(ending)),
                            F.struct(F.lit(i).alias("i"), F.concat(stem, F.lit(replacement)).alias("form"))))
    regular = (
        words.withColumn("_f", F.explode(F.array_compact(F.array(*forms))))
        .join(vocabulary.select(F.col("lemma").alias("_known")).distinct(), F.col("_f.form") == F.col("_known"))
        .groupBy("token")
        .agg(F.min(F.struct(F.length("_f.form").alias("n"), F.col("_f.i").alias("i"),
                            F.col("_f.form").alias("form")))["form"].alias("_regular"))
    )
    special = exceptions.groupBy(F.col("surface").alias("token")).agg(F.min("lemma").alias("_special"))
    return (
        words.join(special, "token", "left").join(regular, "token", "left")
        .select("token", F.coalesce("_special", "_regular").alias("lemma"))
        .where(F.col("lemma") != F.col("token"))
    )


def few_changes(exceptions: DataFrame, vocabulary: DataFrame, most_words: int = IN_ROW_WORDS) -> list[tuple[str, str]] | None:
    """``(token, lemma)`` of all words that the dictionaries change, in the order of their bytes; None if these may be many."""
    surfaces = exceptions.select(F.col("surface").alias("token"))
    lemma = F.col("lemma")
    forms = [lemma]
    for ending, replacement in NOUN_ENDINGS:
        stem = F.substring(lemma, F.lit(1), F.length(lemma) - len(replacement))
        forms.append(F.when(F.endswith(lemma, F.lit(replacement)), F.concat(stem, F.lit(ending))))
    lemmas = vocabulary.select("lemma").limit(most_words + 1)
    if lemmas.count() > most_words or surfaces.limit(most_words + 1).count() > most_words:
        return None
    words = vocabulary.select(F.explode(F.array_compact(F.array(*forms))).alias("token")).union(surfaces).where("token is not null").distinct()
    found = changed_words(words, exceptions, vocabulary).limit(most_words + 1).collect()
    return None if len(found) > most_words else sorted(((r["token"], r["lemma"]) for r in found), key=lambda pair: pair[0].encode())


def _changed(token: Column, changes: Sequence[tuple[str, str]]) -> Column:
    """The lemma of a token: a set says whether it changes, a binary search finds what to."""
    if not changes:
        return token
    words, lemmas = (F.from_json(F.lit(json.dumps(values)), "array<string>") for values in zip(*changes))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(changes).bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(changes)) & (F.get(words, at + step - 1) <= token), at + step).otherwise(at))
    return F.when(token.isin([w for w, _ in changes]), F.get(lemmas, place - 1)).otherwise(token)
