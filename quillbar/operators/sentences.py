"""Sentence ends and word tokens with abbreviations learned from the texts themselves (Kiss and Strunk, 2006), then Treebank tokens.

A word with a final period is an abbreviation where the period comes with it far more often than with words in general (a
log-likelihood ratio, lowered for long words and for uses without the period), or where it is a capital alone. After an
abbreviation or an ellipsis a sentence ends only if the next word has a capital and is known as a sentence starter: it occurs in small letters,
and never with a capital inside a sentence. Any other final period, exclamation or question mark ends a sentence.

Words are counted by type with partial sums on every task. Only words with a period travel, and only to meet the abbreviations; a list of
checked size is broadcast instead. What comes back is one small record for each text that has abbreviations.

A null or empty text has no sentence. ``key`` identifies a row. Words are runs of non-space characters; a corpus of few words gives few abbreviations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillbar.functions.fixed_values import ABBREVIATION_CUT, ABBREVIATION_PERIOD_RATE, SPLIT_WORDS
from quillbar.functions.text import SPACE, tokenize
from quillbar.operators.lexicon import LOOKUP_ROWS, lookup
from quillbar.session import materialize

OPENERS, CLOSERS = r"""["'(\[{]""", r"""["')\]}]"""
OPENING, CLOSING = "\"'([{", "\"')]}"


def _parts(text: Column) -> Column:
    """The words of a text: ``w`` as it stands, ``core`` without quotes and brackets around it, and what is known of the core."""
    words = F.coalesce(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)), F.array().cast("array<string>"))
    return F.transform(F.transform(words, lambda w: F.struct(w.alias("w"), _core(w).alias("core"))), _known)


def _core(word: Column) -> Column:
    """The word without quotes and brackets around it."""
    marked = F.left(word, F.lit(1)).isin(list(OPENING)) | F.right(word, F.lit(1)).isin(list(CLOSING))
    return F.when(marked, F.regexp_replace(word, f"^{OPENERS}+|{CLOSERS}+$", "")).otherwise(word)


def _letter(core: Column, first: str, last: str, pattern: str) -> Column:
    """Whether a word begins with a letter of a kind; only letters beyond ASCII need the pattern."""
    head = F.left(core, F.lit(1))
    return F.when(head < "\x80", head.between(first, last)).otherwise(F.rlike(core, F.lit(pattern)))


def _known(x: Column) -> Column:
    core = x["core"]
    point, dotted = F.endswith(core, F.lit(".")), _dotted(core)
    bare = F.when(dotted, F.substring(core, F.lit(1), F.char_length(core) - 1)).otherwise(core)
    return F.struct(
        x["w"].alias("w"), core.alias("core"), F.lower(bare).alias("base"), dotted.alias("dotted"),
        _letter(core, "A", "Z", r"^\p{Lu}").alias("cap"), _letter(core, "a", "z", r"^\p{Ll}").alias("small"),
        _stops(core).alias("stop"), (point & (F.rlike(core, F.lit(r"^\p{Lu}\.$")) | F.endswith(core, F.lit("..")))).alias("sure"))


def _dotted(core: Column) -> Column:
    return F.endswith(core, F.lit(".")) & ~F.endswith(core, F.lit(".."))


def _stops(core: Column) -> Column:
    return F.right(core, F.lit(1)).isin(".", "!", "?")


def word_types(parts: DataFrame) -> DataFrame:
    """``base, n, dotted, small, inside``: uses of each word, those with a period, in small letters, and with a capital inside a sentence."""
    p = F.col("_parts")
    uses = F.transform(p, lambda x, i: F.struct(
        x["base"].alias("base"), x["dotted"].alias("dotted"), x["small"].alias("small"),
        (x["cap"] & (i > 0) & ~F.coalesce(F.get(p, i - 1)["stop"], F.lit(True))).alias("inside")))
    return parts.select(F.inline(uses)).groupBy("base").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in ("dotted", "small", "inside")])


def abbreviations(types: DataFrame, cut: float = ABBREVIATION_CUT) -> DataFrame:
    """``base`` of the words that are abbreviations."""
    total = types.agg(F.sum("n").alias("n"), F.sum("dotted").alias("dotted")).first()
    rate = (total["dotted"] or 0) / (total["n"] or 1)
    base, dotted = F.col("base"), F.col("dotted")
    bare = F.col("n") - dotted

    def likelihood(p: float) -> Column:
        return dotted * F.log(F.lit(max(p, 1e-9))) + bare * F.log(F.lit(max(1 - p, 1e-9)))

    dots = F.char_length(base) - F.char_length(F.replace(base, F.lit("."), F.lit("")))
    length = (F.char_length(base) - dots).cast("double")
    ratio = 2 * (likelihood(ABBREVIATION_PERIOD_RATE) - likelihood(rate))
    score = ratio * F.exp(-length) * (dots + 1) * F.pow(length, -bare.cast("double"))
    return types.where((dotted > 0) & F.rlike(base, F.lit(r"\p{L}")) & (score >= cut)).select("base")


def sentence_starters(types: DataFrame) -> DataFrame:
    return types.where("small > 0 and inside = 0").select("base")


def _inside(parts: DataFrame, key: Sequence[str], types: DataFrame, most_rows: int) -> DataFrame:
    """``key, _held``: places of the words with a period that end no sentence."""
    p = F.col("_parts")
    places = F.transform(p, lambda x, i: F.when(
        (x["dotted"] | x["sure"]) & (i < F.size(p) - 1),
        F.struct(i.alias("place"), x["base"].alias("base"), x["sure"].alias("sure"),
                 F.get(p, i + 1)["base"].alias("next"), F.get(p, i + 1)["cap"].alias("next_cap"))))
    found = parts.select(*key, F.inline(F.array_compact(places)))

    def mark(rows: DataFrame, words: DataFrame, column: str, into: str) -> DataFrame:
        words, small = lookup(words, most_rows)
        words = words.select(F.col("base").alias("_base"), F.lit(True).alias(into))
        return rows.join(F.broadcast(words) if small else words, F.col(column) == F.col("_base"), "left").drop("_base")

    short = mark(found, abbreviations(types), "base", "_short").where("sure or _short")
    held = mark(short, sentence_starters(types), "next", "_starts").where(~(F.col("next_cap") & F.coalesce("_starts", F.lit(False))))
    return held.groupBy(*key).agg(F.collect_list("place").alias("_held"))


def _abbreviated(word: Column) -> Column:
    """The tokens of an abbreviation inside a sentence, which keeps its period."""
    core = _core(word)
    at = F.instr(word, core)
    before = F.substring(word, F.lit(1), at - 1)
    after = F.substring(word, at + F.char_length(core), F.char_length(word))
    return F.concat(F.regexp_extract_all(before, F.lit("."), F.lit(0)), F.array(core), F.regexp_extract_all(after, F.lit("."), F.lit(0)))


def _tokens(text: Column) -> Column:
    """Tokens of some words joined by spaces."""
    found = tokenize(text)
    split = F.flatten(F.transform(found, lambda t: F.when(
        F.lower(t).isin(list(SPLIT_WORDS)), F.array(F.substring(t, 1, 3), F.substring(t, 4, 99))).otherwise(F.array(t))))
    heads, tails = ({w[part] for w in SPLIT_WORDS} for part in (slice(1), slice(1, None)))
    maybe = F.rlike(text, F.lit(f"(?i)[{''.join(sorted(heads))}](?:{'|'.join(sorted(tails))})"))
    return F.when(maybe, split).otherwise(found)


def tokenize_sentences(df: DataFrame, text: str, key: Sequence[str], into: str = "sentences", most_rows: int = LOOKUP_ROWS) -> DataFrame:
    """``key`` and ``into``: the sentences of each text, each an array of tokens."""
    key = list(key)
    parts = materialize(df.select(*key, _parts(F.col(text)).alias("_parts")))
    held = _inside(parts, key, materialize(word_types(parts)), most_rows)
    # the result reads the texts again: a text is a fraction of all that is known of its words, and is what meets its record
    held = held.select(F.struct(*key).alias("_row"), "_held")
    rows = df.select(*key, F.col(text).alias("_text")).withColumn("_row", F.struct(*key)).join(held, "_row", "left").drop("_row")
    words = F.coalesce(F.regexp_extract_all(F.col("_text"), F.lit(f"[^{SPACE}]+"), F.lit(0)), F.array().cast("array<string>"))
    rows = rows.select(*key, words.alias("_words"), "_held")
    stops = F.array_compact(F.transform("_words", lambda w, i: F.when(_stops(_core(w)), i)))
    rows = rows.withColumn("_held", F.coalesce("_held", F.array().cast("array<int>")))
    ends = F.array_except(stops, "_held")
    rows = rows.withColumn("_ends", F.array_union(ends, F.array(F.size("_words") - 1)))
    rows = rows.withColumn("_cuts", F.arrays_zip(
        F.concat(F.array(F.lit(-1)), F.slice("_ends", F.lit(1), F.size("_ends") - 1)).alias("a"), F.col("_ends").alias("b")))

    def sentence(cut: Column) -> Column:
        size = cut["b"] - cut["a"]
        words = F.slice(F.col("_words"), cut["a"] + 2, size)
        inner = F.exists("_held", lambda i: (i > cut["a"]) & (i < cut["b"]))
        apart = F.flatten(F.transform(words, lambda w, j: F.when(
            (j < size - 1) & _dotted(_core(w)), _abbreviated(w)).otherwise(_tokens(w))))
        return F.when(inner, apart).otherwise(_tokens(F.array_join(words, " ")))

    none = F.array().cast("array<array<string>>")
    return rows.select(*key, F.when(F.size("_words") > 0, F.transform("_cuts", sentence)).otherwise(none).alias(into))
