"""Rule-based valence with all published rules (Hutto and Gilbert, 2014): capitals, boosters, negation, contrast, idioms, punctuation.

Words keep their case and their inner punctuation. Each word (with a short lexicon, each word that is in it) is laid out with the words around it, all
from the row's own array; words meet the lexicon, and the few that are in it look up their neighbours, too. Sums per row are taken before anything is shuffled, so what
moves is one small record per row. Idioms and phrases are sought only in rows whose text holds one of them: a single pattern says so.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillbar.functions import fixed_values as fixed
from quillbar.functions.text import SPACE
from quillbar.operators.lexicon import IN_ROW_WORDS, LOOKUP_ROWS, _with_compound, few_words, hit_places, label_by_cut, lookup

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NEAR = 3


def rule_words(text: Column) -> Column:
    """The white-space separated words, without punctuation at their ends where that leaves more than two characters."""
    found = F.coalesce(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)), F.array().cast("array<string>"))
    marks = list(PUNCTUATION)

    def bare(w: Column) -> Column:
        cut = F.btrim(w, F.lit(PUNCTUATION))
        return F.when(F.left(w, F.lit(1)).isin(marks) | F.right(w, F.lit(1)).isin(marks), F.when(F.char_length(cut) > 2, cut).otherwise(w)).otherwise(w)

    return F.transform(found, bare)


def shouted(word: Column) -> Column:
    """Whether a word has letters, and all of them are capitals."""
    # a word that begins with a small letter of ASCII has one that is no capital
    return ~F.left(word, F.lit(1)).between("a", "z") & (F.upper(word) == word) & (F.lower(word) != word)


def emphasis(text: Column) -> Column:
    """What exclamation and question marks add to the size of a text's valence."""
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    asks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    exclaimed = F.least(marks, F.lit(fixed.MOST_EXCLAMATIONS)) * fixed.EXCLAMATION_STEP
    asked = F.when(asks < 2, 0.0).when(asks <= 3, asks * fixed.QUESTION_STEP).otherwise(fixed.QUESTION_MOST)
    return F.coalesce(exclaimed + asked, F.lit(0.0))


def _has_phrase(text: Column, phrases: Sequence[str]) -> Column:
    if not phrases:
        return F.lit(False)
    gap = f"[{SPACE}]+"
    wanted = "|".join(sorted(gap.join(re.escape(w) for w in p.split(" ")) for p in phrases))
    return F.coalesce(F.rlike(F.lower(text), F.lit(f"(?:{wanted})")), F.lit(False))


def _layout(df: DataFrame, key: str, text: str, phrases: Sequence[str], words: Sequence[str] | None = None) -> DataFrame:
    """One row per word, or per word that is among ``words``: ``token`` (lower case), ``caps``, the words before (``b1``...) and after (``a1, a2``), whether those before are in
    capitals, the contrast factor, ``_count``, which sums up to the number of words, and what holds for the whole row."""
    rows = df.select(key, F.col(text).alias("_text"), rule_words(F.col(text)).alias("_w"))
    rows = rows.select(key, "_w", F.transform("_w", F.lower).alias("_l"), emphasis(F.col("_text")).alias("_emph"),
                       _has_phrase(F.col("_text"), phrases).alias("_phrase"))
    loud = F.size(F.filter("_w", shouted))
    rows = rows.withColumns({"_some": (loud > 0) & (loud < F.size("_w")), "_but": F.array_position("_l", F.lit("but"))})
    low, word = F.col("_l"), F.col("_w")

    def place(w: Column, i: Column, count: Column) -> Column:
        before = [F.when(i >= k, F.get(low, i - k)).alias(f"b{k}") for k in range(1, NEAR + 1)]
        loud_before = [F.when(i >= k, F.col("_some") & shouted(F.get(word, i - k))).alias(f"c{k}") for k in range(1, NEAR + 1)]
        turn = F.when((F.col("_but") == 0) | (i + 1 == F.col("_but")), 1.0).when(i + 1 < F.col("_but"), fixed.BEFORE_BUT).otherwise(fixed.AFTER_BUT)
        return F.struct(F.get(low, i).alias("token"), (F.col("_some") & shouted(w)).alias("caps"), *before, *loud_before,
                        F.get(low, i + 1).alias("a1"), F.get(low, i + 2).alias("a2"), turn.alias("turn"), count.alias("_count"))

    if words is None:
        return rows.select(key, "_emph", "_phrase", F.inline_outer(F.transform(word, lambda w, i: place(w, i, F.lit(1)))))
    # the first word of the lexicon, or the one row without a word, counts all words of the text
    rows = rows.withColumns({"_places": hit_places(low, words), "_size": F.size("_w")})
    out = rows.select(key, "_emph", "_phrase", "_size", F.inline_outer(F.transform(
        "_places", lambda i, n: place(F.get(word, i), i, F.when(n == 0, F.col("_size")).otherwise(0)))))
    return out.withColumn("_count", F.coalesce("_count", "_size")).drop("_size")


def _known(hits: DataFrame, lexicon: DataFrame, name: str, word: Column) -> DataFrame:
    """Add whether ``word`` is in the lexicon; a null word is not looked up."""
    other = lexicon.select(F.col("token").alias(f"_{name}"), F.lit(True).alias(name))
    return hits.withColumn("_look", word).join(other, F.col("_look") == F.col(f"_{name}"), "left").drop("_look", f"_{name}").withColumn(
        name, F.coalesce(name, F.lit(False)))


def _of(words: dict[str, float], word: Column) -> Column:
    """The value of a word, 0 for others; words of one value are looked up together."""
    out = F.lit(0.0)
    for value in sorted(set(words.values())):
        out = F.when(word.isin([w for w, v in words.items() if v == value]), value).otherwise(out)
    return out


def _negates(word: Column, negations: Sequence[str]) -> Column:
    return F.coalesce(word.isin(list(negations)) | F.contains(word, F.lit("n't")), F.lit(False))


def _valued(hits: DataFrame, negations: Sequence[str], boosters: dict[str, float], idioms: dict[str, float]) -> DataFrame:
    """Add ``_v``, the valence of a word of the lexicon in its surroundings: a column for each rule, so that none is written out twice."""
    c = F.col
    single = {w: v for w, v in boosters.items() if " " not in w}
    several = {w: v for w, v in boosters.items() if " " in w}
    no_before = F.coalesce((c("b1") == "no") | (c("b2") == "no") | ((c("b3") == "no") & c("b1").isin("or", "nor")), F.lit(False))
    start = F.when(no_before, c("valence") * fixed.NEGATION_FACTOR).when((c("token") == "no") & c("in_a1"), 0.0).otherwise(c("valence"))
    out = hits.withColumn("_v", start)
    out = out.withColumn("_v", c("_v") + F.signum("_v") * F.when(c("caps"), fixed.CAPITALS_STEP).otherwise(0.0))

    def between(k: int, *words: str) -> Column:
        """Whether one of the words stands between the word ``k`` before and this one."""
        return F.coalesce(F.arrays_overlap(F.array(*[c(f"b{j}") for j in range(1, k)]), F.array(*[F.lit(w) for w in words])), F.lit(False))

    for k, weight in ((1, 1.0), (2, 0.95), (3, 0.9)):
        word = c(f"b{k}")
        step = _of(single, word)
        loud = F.when((step != 0) & F.coalesce(c(f"c{k}"), F.lit(False)), fixed.CAPITALS_STEP).otherwise(0.0)
        factor = F.when(_negates(word, negations), fixed.NEGATION_FACTOR).otherwise(1.0)
        if k > 1:
            factor = F.when((word == "never") & between(k, "so", "this"), fixed.NEVER_SO_FACTOR).when(
                (word == "without") & between(k, "doubt"), 1.0).otherwise(factor)
        counts = word.isNotNull() & ~c(f"in_b{k}")
        out = out.withColumn("_step", F.when(counts, (step + loud) * weight).otherwise(0.0)).withColumn("_factor", F.when(counts, factor).otherwise(1.0))
        out = out.withColumn("_v", (c("_v") + F.signum("_v") * c("_step")) * c("_factor")).drop("_step", "_factor")
    phrased = c("_phrase") & c("valence").isNotNull() & c("b3").isNotNull() & ~c("in_b3")
    out = out.withColumn("_v", F.when(phrased, _with_phrases(c("_v"), idioms, several)).otherwise(c("_v")))
    least = F.coalesce((c("b1") == "least") & ~F.coalesce(c("b2").isin("at", "very"), F.lit(False)), F.lit(False)) & ~c("in_b1")
    mild = c("token").isin(list(single)) | F.coalesce((c("token") == "kind") & (c("a1") == "of"), F.lit(False))
    last = F.when(mild, 0.0).when(least, fixed.NEGATION_FACTOR).otherwise(1.0) * c("turn")
    return out.withColumn("_v", c("_v") * last)


def _with_phrases(v: Column, idioms: dict[str, float], several: dict[str, float]) -> Column:
    """The valence after idioms about the word (which set it) and boosters of several words before it (which move it)."""
    near = {k: F.col(k) for k in ("b3", "b2", "b1", "token", "a1", "a2")}
    spans = {name: F.concat_ws(" ", *[near[w] for w in name.split()])
             for name in ("b1 token", "b2 b1 token", "b2 b1", "b3 b2 b1", "b3 b2", "token a1", "token a1 a2", "b1 token a1")}
    out = v
    # from the weakest place to the strongest; one that goes on after the word wins
    for name in ("b3 b2", "b3 b2 b1", "b2 b1", "b2 b1 token", "b1 token", "b1 token a1", "token a1", "token a1 a2"):
        for phrase, value in idioms.items():
            if phrase.count(" ") == name.count(" "):
                out = F.when(spans[name] == phrase, value).otherwise(out)
    for name in ("b3 b2 b1", "b3 b2", "b2 b1"):
        out = out + _of({p: x for p, x in several.items() if p.count(" ") == name.count(" ")}, spans[name])
    return out


def valence_rules(df: DataFrame, key: str, text: str, lexicon: DataFrame, negations: Sequence[str] = fixed.NEGATION_WORDS,
                  boosters: dict[str, float] | None = None, idioms: dict[str, float] | None = None, cut: float = fixed.VALENCE_CUT,
                  most_rows: int = LOOKUP_ROWS) -> DataFrame:
    """``key, compound, p_negative, p_neutral, p_positive, y_pred``.

    ``lexicon`` has ``token`` (lower case), ``valence``, one row per token. ``boosters`` and ``idioms`` may be of several words; an idiom says what
    a word of the lexicon is worth that stands in it or next to it. ``never so`` and ``never this`` raise what follows, ``without doubt`` leaves it;
    words before the first ``but`` count half, words after it one and a half times.
    """
    boosters = fixed.BOOSTER_WORDS if boosters is None else boosters
    idioms = fixed.IDIOMS if idioms is None else idioms
    lexicon = lexicon.select("token", "valence")
    words = few_words(lexicon, most_words=min(most_rows, IN_ROW_WORDS))
    table, small = lookup(lexicon, most_rows)
    table = F.broadcast(table) if small else table
    phrases = [*idioms, *[b for b in boosters if " " in b]]
    hits = _layout(df, key, text, phrases, words).join(table, "token", "left")
    found = F.col("valence").isNotNull()
    for k in range(1, NEAR + 1):
        hits = _known(hits, table, f"in_b{k}", F.when(found, F.col(f"b{k}")))
    hits = _known(hits, table, "in_a1", F.when(found & (F.col("token") == "no"), F.col("a1")))
    hits = _valued(hits, negations, boosters, idioms)
    v = F.col("_v")
    sums = hits.groupBy(key).agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("_s"), F.max("_emph").alias("_emph"),
        F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("_up"),
        F.sum(F.when(v < 0, 1 - v).otherwise(0.0)).alias("_down"),
        (F.coalesce(F.sum("_count"), F.lit(0)) - F.count_if(v != 0)).cast("double").alias("_flat"))
    more = F.col("_emph")
    sums = sums.withColumns({
        "_s": F.col("_s") + F.signum("_s") * more,
        "_up": F.col("_up") + F.when(F.col("_up") > F.col("_down"), more).otherwise(0.0),
        "_down": F.col("_down") + F.when(F.col("_down") > F.col("_up"), more).otherwise(0.0)}).drop("_emph")
    return _with_compound(sums).withColumn("y_pred", label_by_cut(F.col("compound"), cut))
