"""Text cleaning, tokens and flags as column expressions.

Character classes are spelled out because Java's short forms are ASCII only. The patterns run in
linear time on any input, so a text of one 100,000-character word is no harder than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, functions as F

from quillbar.functions.fixed_values import (
    EARNINGS_WORDS, MERGER_WORDS, PROTECTED_TERMS, REGULATORY_WORDS,
)

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"

URL = r"https?://[a-zA-Z!$-_]+"
# A run of non-space characters with an inner @, tried at the start of the run only.
EMAIL = rf"(?<![^{SPACE}])[^{SPACE}][^{SPACE}@]*+@[^{SPACE}]+"
PHONE = rf"(?=\p{{Nd}})(?<![{WORD}])\p{{Nd}}{{3}}[-.]?\p{{Nd}}{{3}}[-.]?\p{{Nd}}{{4}}(?![{WORD}])"
MENTION = rf"@[{WORD}]+"
HASHTAG = rf"#[{WORD}]+"
# Any run of white space but a single plain space, which can stay as it is.
SPACES = rf"[{SPACE}&&[^ ]][{SPACE}]*+| [{SPACE}]++"
CLITIC = rf"([{WORD}])(n't|'(?:s|m|d|ll|re|ve))(?![{WORD}])"
TOKEN = (
    rf"n't(?![{WORD}])|'(?:s|m|d|ll|re|ve)(?![{WORD}])|\.\.\.|--"
    rf"|[{WORD}]++(?:[-.][{WORD}]++|,\p{{Nd}}[{WORD}]*+)*+|[^{SPACE}{WORD}]"
)

ENTITY_FLAGS = [
    "has_earnings_keywords", "has_merger_keywords", "has_regulatory_keywords",
    "has_price_target", "has_percentage", "has_dollar_amount",
]


def drop_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def drop_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "")


def drop_phones(text: Column) -> Column:
    return F.regexp_replace(text, PHONE, "")


def drop_mentions(text: Column) -> Column:
    return F.regexp_replace(text, MENTION, "")


def drop_hashtags(text: Column) -> Column:
    return F.regexp_replace(text, HASHTAG, "")


def _once(text: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a text that is evaluated once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(text), use), F.lit(0))


def squeeze(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def clean_text(text: Column, remove_urls: bool = True, remove_mentions: bool = True,
               remove_hashtags: bool = False) -> Column:
    """Lower-cased text without URLs, e-mail addresses, phone numbers and mentions; NULL gives ''."""
    out = F.lower(text)
    if remove_urls:
        out = drop_urls(out)

    def with_at(t: Column) -> Column:
        t = drop_phones(drop_emails(t))
        return drop_mentions(t) if remove_mentions else t

    out = _once(out, lambda t: F.when(F.contains(t, F.lit("@")), with_at(t)).otherwise(drop_phones(t)))
    if remove_hashtags:
        out = drop_hashtags(out)
    return F.coalesce(squeeze(out), F.lit(""))


def tokenize(text: Column) -> Column:
    """Words, numbers, clitics and single punctuation marks; NULL gives an empty array.

    An approximation of Treebank tokens: no sentence splitting and no abbreviation list.
    """
    parted = _once(text, lambda t: F.when(
        F.contains(t, F.lit("'")), F.regexp_replace(t, CLITIC, "$1 $2")).otherwise(t))
    found = F.regexp_extract_all(parted, F.lit(TOKEN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def stop_words(language: str = "english", keep: Sequence[str] = PROTECTED_TERMS) -> list[str]:
    """Spark's stop words for the language, without the protected terms."""
    protected = set(keep)
    return [w for w in StopWordsRemover.loadDefaultStopWords(language) if w not in protected]


def remove_stopwords(tokens: Column, words: Sequence[str] | None = None,
                     keep: Sequence[str] = PROTECTED_TERMS) -> Column:
    words = stop_words(keep=keep) if words is None else [w for w in words if w not in set(keep)]
    return F.filter(tokens, lambda t: ~t.isin(list(words))) if words else tokens


STEPS = ("clean", "tokenize", "stopwords")


def preprocess_tokens(text: Column, words: Sequence[str] | None = None, steps: Sequence[str] = STEPS,
                      language: str = "english", **cleaning) -> Column:
    """Clean, tokenize, drop stop words: those of ``steps``, always in this order.

    Without ``tokenize`` the text is cut at white space only. ``words`` are the stop words, by default
    Spark's for the language, less the protected terms.
    """
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")
    out = clean_text(text, **cleaning) if "clean" in steps else text
    if "tokenize" in steps:
        out = tokenize(out)
    else:
        out = F.coalesce(F.regexp_extract_all(out, F.lit(f"[^{SPACE}]+"), F.lit(0)), F.array().cast("array<string>"))
    if "stopwords" not in steps:
        return out
    return remove_stopwords(out, stop_words(language) if words is None else words)


def preprocess_text(text: Column, words: Sequence[str] | None = None, steps: Sequence[str] = STEPS,
                    language: str = "english", **cleaning) -> Column:
    """``preprocess_tokens`` joined by spaces."""
    return F.array_join(preprocess_tokens(text, words, steps, language, **cleaning), " ")


def _has_any(lowered: Column, words: Sequence[str], match: str) -> Column:
    if match == "word":
        return F.rlike(lowered, F.lit(rf"(?<![{WORD}])(?:{'|'.join(words)})(?![{WORD}])"))
    if match != "substring":
        raise ValueError("match must be 'substring' or 'word'")
    hit = F.contains(lowered, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(lowered, F.lit(w))
    return hit


def entity_flags(text: Column, lowered: Column | None = None, match: str = "substring") -> dict[str, Column]:
    """The six flags. ``match='substring'`` lets ``deal`` hit ``ideal``; ``'word'`` does not.

    An amount and a price target are both ``$`` followed by a digit: what comes after that digit
    is optional, so the two flags agree.
    """
    lowered = F.lower(text) if lowered is None else lowered
    dollars = F.contains(text, F.lit("$")) & F.rlike(text, F.lit(r"\$\p{Nd}"))
    percent = F.contains(text, F.lit("%")) & F.rlike(text, F.lit(r"\p{Nd}%"))
    flags = {
        "has_earnings_keywords": _has_any(lowered, EARNINGS_WORDS, match),
        "has_merger_keywords": _has_any(lowered, MERGER_WORDS, match),
        "has_regulatory_keywords": _has_any(lowered, REGULATORY_WORDS, match),
        "has_price_target": dollars,
        "has_percentage": percent,
        "has_dollar_amount": dollars,
    }
    return {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}


def text_length(text: Column) -> Column:
    return F.char_length(text)


def word_count(text: Column) -> Column:
    """How many runs of non-space characters the text has."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))
