"""Quality rules by weak supervision.

Rules vote good, bad or abstain on each document. Their accuracies are not set by hand but estimated from how they
agree, by expectation-maximisation over all documents, and a document is kept if the posterior probability that it
is good reaches ``KEEP``. One weak sign is outvoted; several together are not.

All rules come from one pass over the text. Rules being independent given the class, a document matters to the estimate
only by its pattern of votes, of which there are at most ``3 ** rules`` (``MOST_PATTERNS``): Spark counts the patterns of all
documents, the counts go to the driver, and the posterior of each pattern comes back as a broadcast table of that bound. No text is shuffled.

Defined cases: a null text counts as empty; an empty text fails the base rules. An empty table gives an empty table. Every row
is judged by itself, so repeated rows get the same verdict. Other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from quillbar.llm.frames import fresh
from quillbar.llm.words import Texts, count_points, mix, slices, windows

SPAN = 5
KEEP = 0.5
START_GOOD = 0.9
START_RIGHT = {"good": 0.95, "bad": 0.4}
"""Start of the estimate: a rule clears nearly all good documents but notices only its own kind of bad ones."""
ROUNDS = 200
SMOOTHING = 1.0

_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_STRESS = np.zeros(256, dtype=np.int64)
_STRESS[[ord(c) for c in "!?"]] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
            "n_stress", "n_digits", "n_wordlike", "n_top_word", "n_echoes"]
"""Counts of one text: words, characters in words, symbols, repeated lines, words in repeated windows, lines with a
word, letters (bytes), capitals A-Z, exclamation and question marks, digits, words that are mostly letters, the
occurrences of the most frequent word, and words equal to the word before."""


def _sums(weights: np.ndarray, texts: Texts) -> np.ndarray:
    run = np.zeros(len(texts.data) + 1, dtype=np.int64)
    np.cumsum(weights[texts.data], out=run[1:])
    return run


def _repeat_words(texts: Texts, words: np.ndarray) -> np.ndarray:
    """Words that lie in a window of SPAN words found twice or more in the same text, for each text."""
    n = len(texts.offsets) - 1
    ok = texts.inside(SPAN)
    if not ok.any():
        return np.zeros(n, dtype=np.int64)
    m = len(ok)
    place = np.flatnonzero(ok)
    doc = texts.doc[:m][ok]
    named = windows(words, SPAN)[ok] ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(named, kind="stable")
    ranked = named[order]
    same = np.zeros(len(ranked), dtype=bool)
    equal = ranked[1:] == ranked[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    begin = place[order[same]]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + SPAN, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.diff(np.append(0, np.cumsum(covered))[texts.first])


def _lines(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier line, for each text."""
    n = len(texts.offsets) - 1
    if not len(texts.start):
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    breaks = np.flatnonzero(texts.data == 10)
    begin = np.unique(np.concatenate([texts.offsets[:-1], breaks + 1]))
    begin = begin[begin < len(texts.data)]
    stop = np.append(begin[1:], len(texts.data))
    stop = np.where((stop > 0) & (texts.data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop)
    words = np.searchsorted(texts.start, stop) - np.searchsorted(texts.start, begin)
    begin, stop = begin[words > 0], stop[words > 0]
    doc = np.searchsorted(texts.offsets, begin, side="right") - 1
    named = texts.spans(begin, stop) ^ mix(doc.astype(np.uint64) + np.uint64(1)) ^ mix((stop - begin).astype(np.uint64) + np.uint64(77))
    order = np.argsort(named, kind="stable")
    again = named[order][1:] == named[order][:-1]
    return np.bincount(doc, minlength=n), np.bincount(doc[order][1:][again], minlength=n)


def _top_word(texts: Texts, words: np.ndarray) -> np.ndarray:
    n = len(texts.offsets) - 1
    out = np.zeros(n, dtype=np.int64)
    if len(words):
        ranked = np.sort((mix(words) << np.uint64(24)) | (texts.doc.astype(np.uint64) & np.uint64((1 << 24) - 1)))
        new = np.append(0, np.flatnonzero(ranked[1:] != ranked[:-1]) + 1)
        counts = np.diff(np.append(new, len(ranked)))
        np.maximum.at(out, (ranked[new] & np.uint64((1 << 24) - 1)).astype(np.int64), counts)
    return out


def _echoes(texts: Texts, words: np.ndarray) -> np.ndarray:
    """Running number of words equal to the word before in the same text."""
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (texts.doc[1:] == texts.doc[:-1])
    return np.append(0, np.cumsum(same))


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """The features of each text."""
    words = texts.hashes()
    points = count_points(texts.data)
    spread = np.append(0, np.cumsum(points[texts.end] - points[texts.start]))
    letters = _sums(_LETTER, texts)
    in_word = letters[texts.end] - letters[texts.start]
    wordlike = np.append(0, np.cumsum(2 * in_word > texts.end - texts.start))
    lines, again = _lines(texts)

    def by_text(run: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(run[bounds])

    bytes_at = texts.offsets
    return {
        "n_words": texts.count, "word_chars": by_text(spread, texts.first),
        "n_symbols": by_text(_sums(_SYMBOLS, texts), bytes_at), "n_dup_lines": again,
        "n_repeat_words": _repeat_words(texts, words), "n_lines": lines, "n_letters": by_text(letters, bytes_at),
        "n_upper": by_text(_sums(_UPPER, texts), bytes_at), "n_stress": by_text(_sums(_STRESS, texts), bytes_at),
        "n_digits": by_text(_sums(_DIGIT, texts), bytes_at), "n_wordlike": by_text(wordlike, texts.first),
        "n_top_word": _top_word(texts, words), "n_echoes": by_text(_echoes(texts, words), texts.first),
    }


@dataclass(frozen=True)
class Rule:
    """Votes bad at or beyond ``bad`` of the ratio, good at or before ``good``, and abstains between. Texts shorter than ``least`` words get no vote.

    With ``good`` above ``bad`` the ratio counts the other way round.
    """

    name: str
    ratio: Callable[[Column], Column]
    good: float
    bad: float
    least: int = 0

    def vote(self, f: Callable[[str], Column]) -> Column:
        value = self.ratio(f)
        over = (value >= self.bad, value <= self.good) if self.bad > self.good else (value <= self.bad, value >= self.good)
        judged = F.when(over[0], F.lit(-1)).when(over[1], F.lit(1)).otherwise(F.lit(0))
        return F.when(f("n_words") < max(self.least, 1), F.lit(0)).otherwise(judged)


def share(part: str, whole: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda f: f(part) / F.greatest(f(whole), F.lit(1))


RULES = (
    Rule("symbols", share("n_symbols", "n_words"), 0.05, 0.15),
    Rule("capitals", share("n_upper", "n_letters"), 0.2, 0.5),
    Rule("stress", share("n_stress", "n_words"), 0.1, 0.3),
    Rule("wordlike", share("n_wordlike", "n_words"), 0.9, 0.7, least=20),
    Rule("repeated lines", share("n_dup_lines", "n_lines"), 0.1, 0.5),
    Rule("repeated windows", share("n_repeat_words", "n_words"), 0.05, 0.2),
    Rule("one word", share("n_top_word", "n_words"), 0.15, 0.3, least=20),
    Rule("word length", lambda f: F.abs(F.log(F.greatest(f("word_chars") / F.greatest(f("n_words"), F.lit(1)), F.lit(0.1)) / 5.0)), 0.5, 1.0, least=5),
    Rule("length", share("n_words", "n_lines"), 5.0, 1.5, least=10),
    Rule("digits", share("n_digits", "n_letters"), 0.2, 1.0, least=20),
    Rule("echoes", share("n_echoes", "n_words"), 0.05, 0.3),
)
MOST_PATTERNS = 3 ** len(RULES)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The posterior probability of good for each pattern of votes (-1, 0, 1), by expectation-maximisation.

    Each rule has a chance to vote right for either class, smoothed by SMOOTHING votes of START_RIGHT.
    A rule's share of abstentions is taken to be the same for both classes, so abstaining says nothing. Every start and order is fixed, so reruns agree.
    """
    if not len(patterns):
        return np.zeros(0)
    good, bad = (patterns == 1).astype(float), (patterns == -1).astype(float)
    weights = counts.astype(float)
    rules = patterns.shape[1]
    prior, right_good, right_bad = START_GOOD, np.full(rules, START_RIGHT["good"]), np.full(rules, START_RIGHT["bad"])
    for _ in range(rounds):
        for_good = good @ np.log(right_good) + bad @ np.log(1 - right_good) + math.log(prior)
        for_bad = bad @ np.log(right_bad) + good @ np.log(1 - right_bad) + math.log(1 - prior)
        posterior = 1 / (1 + np.exp(np.clip(for_bad - for_good, -500, 500)))
        is_good, is_bad = weights * posterior, weights * (1 - posterior)
        prior = (is_good.sum() + SMOOTHING * START_GOOD) / (weights.sum() + SMOOTHING)
        right_good = (is_good @ good + SMOOTHING * START_RIGHT["good"]) / (is_good @ (good + bad) + SMOOTHING)
        right_bad = (is_bad @ bad + SMOOTHING * START_RIGHT["bad"]) / (is_bad @ (good + bad) + SMOOTHING)
        # a rule is never taken to be worse than chance, so that both classes keep their meaning
        right_good = np.clip(right_good, 1e-6, 1 - 1e-6)
        right_bad = np.clip(np.maximum(right_bad, 1 - right_good), 1e-6, 1 - 1e-6)
    return posterior


def features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The rows with the columns of FEATURES added, and the names they got (longer where a column is there already)."""
    names = dict(zip(FEATURES, fresh(docs, *FEATURES)))
    schema = StructType([*docs.schema.fields])
    for name in names.values():
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for low, high, texts in slices(batch.column(at)):
                found = measure(texts)
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *[pa.array(found[f].astype(np.int64)) for f in FEATURES]],
                    names=[*batch.schema.names, *names.values()])

    return docs.mapInArrow(run, schema), names


def _code(names: dict[str, str]) -> Column:
    """The pattern of votes as one number in base 3."""
    out = F.lit(0)
    for rule in RULES:
        out = out * 3 + (rule.vote(lambda f: F.col(names[f])) + 1)
    return out.cast("int")


def base_failed(names: dict[str, str]) -> Column:
    words = F.col(names["n_words"])
    return (words < 10) | (100 * F.col(names["n_repeat_words"]) > 20 * words)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, posterior, base_failed, kept`` added."""
    posterior, failed, kept = fresh(docs, "posterior", "base_failed", "kept")
    measured, names = features(docs, text)
    counting, count_names = features(docs.select(text), text)
    found = counting.groupBy(_code(count_names).alias("code")).count().collect()
    codes = np.array(sorted(r["code"] for r in found), dtype=np.int64)
    counts = dict((r["code"], r["count"]) for r in found)
    digits = (codes[:, None] // 3 ** np.arange(len(RULES) - 1, -1, -1)) % 3 - 1 if len(codes) else np.zeros((0, len(RULES)))
    chances = estimate(digits, np.array([counts[c] for c in codes.tolist()]))
    code, seen = fresh(measured, "code", "seen")
    known = docs.sparkSession.createDataFrame(list(zip(codes.tolist(), chances.tolist())), f"{seen} int, {posterior} double")
    out = measured.withColumn(code, _code(names)).join(F.broadcast(known), F.col(code) == F.col(seen), "left")
    out = out.withColumn(failed, base_failed(names)).withColumn(kept, ~F.col(failed) & (F.col(posterior) >= KEEP))
    return out.select(*docs.columns, *[names[f] for f in FEATURES[:5]], posterior, failed, kept)
