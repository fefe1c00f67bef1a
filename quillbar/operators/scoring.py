"""Scoring with a numeric model in Arrow batches.

The model is fitted on Spark, exported to arrays, and broadcast once; a worker unpacks it once and keeps it for all its
tasks. Rows arrive as lists of tokens in record batches. Long texts are cut into windows of ``max_length`` tokens, so that nothing is cut off;
the windows of a batch are sorted by length and scored in padded matrices of near-equal lengths, and a row's score is put together from
its windows. No Python object is made for a token.

A word model of more words than a worker should hold is split (``SplitModel``): workers hold its frequent words, and only the words of a row that are not
among those meet the rest of the model by shuffle.

A model of one's own needs three methods: ``encode(tokens)`` gives each token of a flat array its number, 0 for padding and unknown
ones; ``logits(ids)`` scores a padded matrix of windows, a row of class scores for each; ``finish(summed, windows, tokens)`` turns the sums over a row's
windows into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, functions as F

from quillbar.functions.fixed_values import LABELS
from quillbar.operators.lexicon import with_tokens
from quillbar.operators.models import PROBABILITIES, NaiveBayes, class_index
from quillbar.session import materialize

BATCH_SIZE = 64
MAX_LENGTH = 512
MOST_WORDS = 4_000_000
"""A model that every worker holds has a proven bound: more words than this are an error (about 100 MB of weights)."""
SUMS = [f"_s_{c}" for c in LABELS]


@dataclass
class LinearModel:
    """A softmax over sums of word weights: naive Bayes and logistic regression on word counts have this form.

    ``words[i]`` has the class weights ``weights[i]``; a class with bias ``-inf`` never wins. Unknown words weigh nothing.
    """

    words: pa.Array
    weights: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        if len(self.words) > MOST_WORDS:
            raise ValueError(f"{len(self.words):,} words are more than a worker should hold ({MOST_WORDS:,})")
        self.rows = np.concatenate([np.zeros((1, len(self.bias))), np.asarray(self.weights, dtype=np.float64).reshape(-1, len(self.bias))])

    @classmethod
    def of_naive_bayes(cls, fitted: NaiveBayes) -> LinearModel | SplitModel:
        """A model that has frequent words apart, as it is too large to broadcast, becomes a split one."""
        columns = [f"l_{c}" for c in LABELS]
        words = fitted.words if fitted.hot_words is None else fitted.hot_words
        table = words.select("token", *columns).limit(MOST_WORDS + 1).toArrow()
        prior = fitted.priors.first()
        bias = np.array([-np.inf if prior[c] is None else prior[c] for c in columns])
        held = cls(table["token"].combine_chunks(), np.column_stack([table[c].to_numpy() for c in columns]), bias)
        if fitted.hot_words is None:
            return held
        least = fitted.hot_words.agg(F.min("n")).first()[0]
        rest = fitted.words if least is None else fitted.words.where(F.col("n") < least)
        return SplitModel(held, rest.select("token", *[F.col(c).alias(s) for c, s in zip(columns, SUMS)]))

    @classmethod
    def of_logistic(cls, fitted: PipelineModel) -> LinearModel:
        """From ``fit_word_logistic``."""
        counter, regression = fitted.stages
        return cls(pa.array(counter.vocabulary, pa.string()), regression.coefficientMatrix.toArray().T, regression.interceptVector.toArray())

    def encode(self, tokens: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(tokens, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return self.rows[ids].sum(axis=1)

    def finish(self, summed: np.ndarray, windows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        scores = summed + self.bias
        raised = np.exp(scores - scores.max(axis=1, keepdims=True))
        return raised / raised.sum(axis=1, keepdims=True)


@dataclass
class SplitModel:
    """A linear model of any number of words: ``held`` has the frequent ones, the table ``rest`` (``token`` and the weights ``SUMS``) all others, a row each."""

    held: LinearModel
    rest: DataFrame


def fit_word_logistic(train: DataFrame, tokens: str, label: str, words: int = 1 << 18, iterations: int = 20) -> PipelineModel:
    """Three-class logistic regression on the counts of the ``words`` most frequent words of a token column."""
    rows = train.select(F.col(tokens), class_index(F.col(label)).cast("double").alias("_class")).where(F.col("_class").isNotNull())
    return Pipeline(stages=[
        CountVectorizer(inputCol=tokens, outputCol="_counts", vocabSize=words),
        LogisticRegression(featuresCol="_counts", labelCol="_class", maxIter=iterations, regParam=0.01, family="multinomial",
                           probabilityCol="_p", predictionCol="_best", rawPredictionCol="_raw"),
    ]).fit(rows)


def windows_of(lengths: np.ndarray, max_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first token and length of every window; a row without tokens has none."""
    counts = -(-lengths // max_length)
    row = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(np.cumsum(lengths) - lengths, counts) + place * max_length
    return row, first, np.minimum(lengths[row] - place * max_length, max_length)


def summed_lists(lists: pa.Array, model: Any, batch_size: int, max_length: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every list of tokens the sums over its windows, their number and that of the tokens; and the numbers of all tokens."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = np.append(model.encode(lists.flatten()), 0)
    row, first, size = windows_of(lengths, max_length)
    summed = np.zeros((len(lengths), classes))
    order = np.argsort(size, kind="stable")
    for some in np.split(order, np.arange(batch_size, len(order), batch_size)) if len(order) else []:
        at = np.arange(int(size[some].max()))
        # places beyond a window's end read the padding id that was put last
        matrix = ids[np.where(at < size[some][:, None], first[some][:, None] + at, len(ids) - 1)]
        np.add.at(summed, row[some], model.logits(matrix))
    return summed, np.bincount(row, minlength=len(lengths)), lengths, ids[:-1]


def score_lists(lists: pa.Array, model: Any, batch_size: int = BATCH_SIZE, max_length: int = MAX_LENGTH, classes: int = len(LABELS)) -> np.ndarray:
    """Class probabilities of every list of tokens."""
    return model.finish(*summed_lists(lists, model, batch_size, max_length, classes)[:3])


def _scored(key: pa.Array, found: np.ndarray, name: str) -> pa.RecordBatch:
    best = np.array(LABELS)[found.argmax(axis=1)].tolist()
    return pa.RecordBatch.from_arrays(
        [key, pa.array(best, pa.string()), *[pa.array(found[:, i]) for i in range(len(LABELS))]], names=[name, "y_pred", *PROBABILITIES])


def score_model(df: DataFrame, key: str, text: str, model: Any, batch_size: int = BATCH_SIZE, max_length: int = MAX_LENGTH) -> DataFrame:
    """``key, y_pred, p_negative, p_neutral, p_positive``: the model's probabilities for each text (or array of tokens) and its best class,
    the first of equals. A text without tokens gets what ``finish`` makes of zero sums."""
    tokens = with_tokens(df, key, text)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, y_pred string, " + ", ".join(f"{p} double" for p in PROBABILITIES)
    if isinstance(model, SplitModel):
        return _score_split(tokens, key, kind, schema, model, batch_size, max_length)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # unpacked by the first task of a worker, kept for the next ones
        for batch in batches:
            yield _scored(batch.column(0), score_lists(batch.column(1), held, batch_size, max_length), key)

    return tokens.mapInArrow(run, schema)


def _score_split(tokens: DataFrame, key: str, kind: str, schema: str, model: SplitModel, batch_size: int, max_length: int) -> DataFrame:
    """Rows are summed over the words that workers hold, where they are; the others of their words move, each with its row's number, and their sums come back."""
    shared = tokens.sparkSession.sparkContext.broadcast(model.held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            lists = batch.column(1)
            summed, windows, lengths, ids = summed_lists(lists, held, batch_size, max_length, len(LABELS))
            flat = lists.flatten()
            away = (ids == 0) & pc.is_valid(flat).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(away))[np.append(0, np.cumsum(lengths))]
            rest = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(pa.array(away)))
            rows = number + np.arange(len(lengths))
            number += len(lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows), *[pa.array(summed[:, i]) for i in range(len(LABELS))], pa.array(windows), pa.array(lengths), rest],
                names=[key, "_row", *SUMS, "_windows", "_count", "_rest"])

    kept = ", ".join(f"{s} double" for s in SUMS)
    # kept once, so that a row's number is the same for all that read it
    seen = materialize(tokens.mapInArrow(run, f"`{key}` {kind}, _row long, {kept}, _windows long, _count long, _rest array<string>"))
    away = seen.select("_row", F.explode("_rest").alias("token")).join(model.rest, "token")
    added = away.groupBy("_row").agg(*[F.sum(s).alias(f"{s}_more") for s in SUMS])
    whole = seen.drop("_rest").join(added, "_row", "left").select(
        key, *[(F.col(s) + F.coalesce(F.col(f"{s}_more"), F.lit(0.0))).alias(s) for s in SUMS], "_windows", "_count")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)]
            yield _scored(batch.column(0), held.finish(np.column_stack(columns[:len(SUMS)]), *columns[len(SUMS):]), key)

    return whole.mapInArrow(finish, schema)
