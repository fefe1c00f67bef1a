"""Trained, combined, baseline and caller-supplied classifiers.

Every scorer returns a table keyed by row: ``key, y_pred`` and, where it has them,
``p_negative, p_neutral, p_positive``. Classifier internals are this project's own choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from quillbar.functions.fixed_values import LABELS
from quillbar.functions.numeric import hash_int
from quillbar.operators.lexicon import with_tokens
from quillbar.session import materialize

BROADCAST_ROWS = 1_000_000
PROBABILITIES = [f"p_{c}" for c in LABELS]


def class_index(label: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(LABELS):
        out = F.when(label == name, F.lit(i)).otherwise(out)
    return out


def class_name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in LABELS]), index.cast("int"))


def best_class(scores: list[Column]) -> Column:
    """The class with the highest score; the first of equals. A missing score never wins."""
    top = F.greatest(*scores)
    out = F.when(scores[2] == top, LABELS[2])
    out = F.when(scores[1] == top, LABELS[1]).otherwise(out)
    return F.when(scores[0] == top, LABELS[0]).otherwise(out)


def fit_logistic(train: DataFrame, text: str, label: str, features: int = 1 << 16, iterations: int = 20) -> PipelineModel:
    """Three-class logistic regression on hashed TF-IDF features of a text, or of an array of tokens."""
    ready = train.schema[text].dataType.typeName() == "array"
    prepared = train.select(F.col(text), class_index(F.col(label)).cast("double").alias("_class")).where(
        F.col("_class").isNotNull())
    stages = [] if ready else [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+")]
    stages += [
        HashingTF(inputCol=text if ready else "_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_class", maxIter=iterations, regParam=0.01,
                           family="multinomial", probabilityCol="_p", predictionCol="_best", rawPredictionCol="_raw"),
    ]
    return Pipeline(stages=stages).fit(prepared)


def score_logistic(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    scored = model.transform(df).withColumn("_a", vector_to_array("_p"))
    p = [F.coalesce(F.get("_a", F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(PROBABILITIES)]
    return scored.select(key, class_name(F.col("_best")).alias("y_pred"), *p)


def _least_count(words: DataFrame, most: int) -> int:
    """The count from which on there are at most ``most`` words. There are few different counts, as they sum up to the tokens."""
    kept, least = 0, None
    for row in words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():
        kept += row["words"]
        if kept > most:
            return row["n"] + 1 if least is None else least
        least = row["n"]
    return least or 0


class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing, as two count tables.

    ``words`` holds the log likelihood of each training token in each class, ``priors`` the class
    log priors. Tokens unseen in training are ignored.
    """

    def __init__(self, words: DataFrame, priors: DataFrame, hot_words: DataFrame | None = None):
        self.words = words
        self.priors = priors
        self.hot_words = hot_words

    @classmethod
    def fit(cls, train: DataFrame, text: str, label: str, smoothing: float = 1.0,
            broadcast_rows: int = BROADCAST_ROWS) -> NaiveBayes:
        rows = train.where(F.col(label).isin(LABELS))
        counts = (
            with_tokens(rows, label, text).select(F.col(label).alias("label"), F.explode_outer("_tokens").alias("token"))
            .where(F.col("token").isNotNull()).groupBy("token").agg(*[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in LABELS])
        )
        counts = materialize(counts)
        totals = counts.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n_{c}").alias(f"t_{c}") for c in LABELS])
        total = totals.first()
        words = counts.select("token", F.expr(" + ".join(f"n_{c}" for c in LABELS)).alias("n"), *[
            F.ln((F.col(f"n_{c}") + smoothing) / F.lit(float((total[f"t_{c}"] or 0) + smoothing * total["v"]))).alias(f"l_{c}")
            for c in LABELS])
        sizes = rows.agg(*[F.count_if(F.col(label) == c).cast("double").alias(c) for c in LABELS])
        every = sum(F.col(c) for c in LABELS)
        priors = sizes.select(*[F.when(F.col(c) > 0, F.ln(F.col(c) / every)).alias(f"l_{c}") for c in LABELS])
        if total["v"] <= broadcast_rows:
            return cls(words, priors)
        return cls(words, priors, words.where(F.col("n") >= _least_count(words, broadcast_rows)))

    def _summed(self, tokens: DataFrame, key: str) -> DataFrame:
        """Summed log likelihoods per row. A small model is broadcast, so rows are summed where
        they are; of a large one only the frequent words are, and rare words, each few, meet by
        shuffle."""
        likelihoods = [f"l_{c}" for c in LABELS]
        model = self.words.drop("n")
        if self.hot_words is None:
            found = tokens.join(F.broadcast(model), "token", "left")
            return found.groupBy(key).agg(*[F.sum(n).alias(f"_s_{n}") for n in likelihoods])
        # frequent words are summed where they are; of a row only its sums and its rare words are left
        seen = tokens.join(F.broadcast(self.hot_words.drop("n")), "token", "left")
        rare = F.when(F.col(likelihoods[0]).isNull(), F.col("token")).alias("token")
        left = materialize(seen.groupBy(F.col(key), rare).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(n) for n in likelihoods]))
        met = left.where("token is not null").select(key, "token", "_n").join(model, "token").select(
            key, *[(F.col("_n") * F.col(n)).alias(n) for n in likelihoods])
        found = left.select(key, *likelihoods).unionByName(met)
        return found.groupBy(key).agg(*[F.sum(n).alias(f"_s_{n}") for n in likelihoods])

    def score(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """``key, y_pred, p_*, score_*``; the scores are joint log likelihoods."""
        tokens = with_tokens(df, key, text).select(key, F.explode_outer("_tokens").alias("token"))
        found = self._summed(tokens, key)
        prior = self.priors.first()
        scored = found.select(key, *[
            (F.coalesce(F.col(f"_s_l_{c}"), F.lit(0.0)) + F.lit(prior[f"l_{c}"])).alias(f"score_{c}") for c in LABELS])
        scores = [F.col(f"score_{c}") for c in LABELS]
        top = F.greatest(*scores)
        weights = [F.coalesce(F.exp(s - top), F.lit(0.0)) for s in scores]
        total = weights[0] + weights[1] + weights[2]
        return scored.withColumns({
            "y_pred": best_class(scores),
            **{p: w / total for p, w in zip(PROBABILITIES, weights)},
        })


def ensemble_vote(predictions: DataFrame, key: str = "row_id") -> DataFrame:
    """Majority vote over the models; among equals the first class wins."""
    votes = predictions.groupBy(key).agg(*[F.count_if(F.col("y_pred") == c).alias(f"n_{c}") for c in LABELS])
    return votes.withColumn("y_pred", best_class([F.col(f"n_{c}") for c in LABELS]))


def ensemble_mean(predictions: DataFrame, key: str = "row_id") -> DataFrame:
    """Mean class probabilities over the models and the class they favour.

    Probabilities are compared at 12 digits, so the order of summing does not decide a tie.
    """
    means = predictions.groupBy(key).agg(*[F.avg(p).alias(p) for p in PROBABILITIES])
    return means.withColumn("y_pred", best_class([F.round(p, 12) for p in PROBABILITIES]))


def majority_label(train: DataFrame, label: str) -> DataFrame:
    """One row with the most frequent label; the first in class order among equals."""
    counts = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), class_index(F.col(label))).limit(1).select(F.col(label).alias("y_pred"))


def baseline_majority(train: DataFrame, df: DataFrame, key: str, label: str) -> DataFrame:
    return df.select(key, majority_label(train, label).scalar().alias("y_pred"))


def baseline_random(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.select(key, class_name(hash_int(seed, "class", F.col(key)) % 3).alias("y_pred"))


def plug_in_scorer(df: DataFrame, key: str, text: str, load: Callable[[], Callable], batch_size: int = 16) -> DataFrame:
    """Score with a model the caller brings.

    ``load()`` runs once per task and returns ``score(list of texts) -> rows of three
    probabilities`` (negative, neutral, positive). Texts arrive in batches of ``batch_size``.
    """
    fields = df.select(key).schema.fields[0]
    schema = f"{key} {fields.dataType.simpleString()}, y_pred string, " + ", ".join(f"{p} double" for p in PROBABILITIES)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        score = load()
        for batch in batches:
            texts = batch[text].fillna("").tolist()
            rows = [np.asarray(score(texts[i:i + batch_size]), dtype=float) for i in range(0, len(texts), batch_size)]
            table = np.concatenate(rows) if rows else np.zeros((0, 3))
            yield pd.DataFrame({
                key: batch[key],
                "y_pred": [LABELS[i] for i in table.argmax(axis=1)],
                **{p: table[:, i] for i, p in enumerate(PROBABILITIES)},
            })

    return df.select(key, text).mapInPandas(run, schema)
