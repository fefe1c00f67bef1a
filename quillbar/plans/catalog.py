"""The registered queries. Each takes (spark, sf_dir) and reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillbar.functions import text as tx
from quillbar.functions.fixed_values import LABELS
from quillbar.functions.numeric import tidy, tidy_columns
from quillbar.operators import (
    align, bars as bar_ops, classify, compare, features, lemmas, lexicon, models, risk, scoring, sentences, splits, stats, strategy, summary, valence,
)
from quillbar.operators.ordered import RowOrder
from quillbar.plans.workflow import compare_models
from quillbar.session import materialize
from quillbar.sources import bars as bar_source, inputs, synth

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def keep(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return keep


# ---- sources -------------------------------------------------------------------------------

@query("bars_load")
def _(s, d):
    return bar_source.load_bars(
        s, f"{d}/orders.parquet", symbols=inputs.TICKERS[:3], start="1995-01-01", end="1997-01-01",
        columns={"o_orderpriority": "symbol", "o_orderdate": "date", "o_totalprice": "close", "o_orderkey": "tick"})


@query("bars_filter")
def _(s, d):
    return bar_source.filter_bars(inputs.bars(s, d), ["1-URGENT", "5-LOW"], "1996-01-01", "1998-01-01")


@query("bars_normalize")
def _(s, d):
    raw = inputs.bars(s, d)
    return bar_source.normalize_columns(raw.withColumnsRenamed({c: c.capitalize() for c in raw.columns}))


@query("bars_wide_to_long")
def _(s, d):
    fields = [F.first(c).alias(c) for c in bar_source.FIELDS]
    wide = inputs.bars(s, d).groupBy("date").pivot("symbol", inputs.TICKERS).agg(*fields)
    return bar_source.wide_to_long(wide, [*inputs.TICKERS, "0-ABSENT"])


@query("bars_union")
def _(s, d):
    return bar_source.union_bars([inputs.bars(s, d), inputs.bars_wide(s, d)])


@query("synth_headlines")
def _(s, d):
    ids = inputs.table(s, d, "documents").select(F.col("doc_id").alias("headline_id"))
    return synth.synth_headlines(ids)


def _days(s, d):
    return inputs.bars(s, d).select("symbol", "date")


@query("synth_bars")
def _(s, d):
    return synth.synth_bars(_days(s, d))


@query("synth_bars_indicators")
def _(s, d):
    return tidy_columns(synth.synth_bars_indicators(_days(s, d)), bar_ops.INDICATORS)


@query("synth_bars_impact")
def _(s, d):
    labels = inputs.truth(s, d).select(F.col("row_id").alias("headline_id"), F.col("y_true").alias("sentiment_label"))
    dated = inputs.headlines(s, d).select("headline_id", "symbol", "date").join(labels, "headline_id")
    return synth.synth_bars(_days(s, d), impact=synth.sentiment_impact(dated))


# ---- shape, preview, sample, overview ------------------------------------------------------

@query("headline_shape")
def _(s, d):
    return summary.headline_shape(inputs.headlines(s, d).select("headline_id", "headline")).select("headline_id", "text_length", "word_count")


@query("preview")
def _(s, d):
    return summary.preview(inputs.headlines(s, d), ["headline_id", "date", "symbol", "headline"], ["date", "headline_id"])


@query("sample_n")
def _(s, d):
    return summary.sample_rows(inputs.headlines(s, d).select("headline_id", "date", "symbol"), "headline_id", 200)


@query("label_distribution")
def _(s, d):
    return summary.label_distribution(inputs.truth(s, d), "y_true")


@query("dataset_overview")
def _(s, d):
    return tidy_columns(summary.dataset_overview(inputs.headlines(s, d)), ["mean_text_length"])


# ---- headlines beside bars -----------------------------------------------------------------

@query("headline_bar_join")
def _(s, d):
    keys = inputs.headlines(s, d).select("headline_id", "date", "symbol", "lang", "source")
    return align.join_bars(keys, inputs.bars(s, d))


def _daily(s, d):
    scored = lexicon.polarity(inputs.headlines(s, d), "headline_id", "headline", inputs.lexicon(s))
    keys = inputs.headlines(s, d).select("headline_id", "symbol", "date")
    return align.daily_score(keys.join(scored, "headline_id"), "polarity")


def _closes(s, d):
    return inputs.bars(s, d).select("symbol", "date", "close")


@query("sentiment_interpolate")
def _(s, d):
    return tidy_columns(align.interpolate(_closes(s, d), _daily(s, d)), ["sentiment"])


@query("sentiment_asof")
def _(s, d):
    return tidy_columns(align.asof(_closes(s, d), _daily(s, d)), ["sentiment"])


@query("asof_ticks")
def _(s, d):
    found = align.asof_ticks(inputs.timed_ticks(s, d), inputs.timed_points(s, d))
    return found.select("row_id", "symbol", "value", "age_seconds")


@query("sentiment_price_overlay")
def _(s, d):
    return tidy_columns(align.overlay(_closes(s, d), _daily(s, d)), ["sentiment"])


# ---- indicators and labels -----------------------------------------------------------------

def _indicator(df, column):
    return df.select("symbol", "date", tidy(F.col(column)).alias(column))


@query("ret_1d")
def _(s, d):
    return _indicator(bar_ops.returns(_closes(s, d)), "price_change_1d")


@query("ret_7d")
def _(s, d):
    return _indicator(bar_ops.returns(_closes(s, d), 7, "price_change_7d"), "price_change_7d")


def _rolling_query(name, column, aggregate, source, rows):
    @query(name)
    def _(s, d):
        return _indicator(bar_ops.rolling(inputs.bars(s, d), aggregate, source, rows, column), column)


_rolling_query("volume_avg_20", "volume_20d_avg", F.avg, "volume", 20)
_rolling_query("ma_5", "ma_5d", F.avg, "close", 5)
_rolling_query("ma_20", "ma_20d", F.avg, "close", 20)
_rolling_query("ma_50", "ma_50d", F.avg, "close", 50)


def _all_indicators(s, d):
    return bar_ops.add_indicators(inputs.bars(s, d))


@query("volume_ratio")
def _(s, d):
    return _indicator(_all_indicators(s, d), "volume_ratio")


@query("volatility_7")
def _(s, d):
    return _indicator(_all_indicators(s, d), "volatility_7d")


@query("volatility_20")
def _(s, d):
    return _indicator(_all_indicators(s, d), "volatility_20d")


@query("price_vs_ma")
def _(s, d):
    names = ["price_vs_ma5", "price_vs_ma20", "price_vs_ma50"]
    return tidy_columns(_all_indicators(s, d).select("symbol", "date", *names), names)


@query("rsi_14")
def _(s, d):
    return _indicator(bar_ops.rsi(_closes(s, d)), "rsi_14d")


@query("rsi_14_frame")
def _(s, d):
    return _indicator(bar_ops.rsi(_closes(s, d), scope="frame"), "rsi_14d")


@query("technical_indicators")
def _(s, d):
    return tidy_columns(_all_indicators(s, d), bar_ops.INDICATORS)


@query("technical_indicators_wide")
def _(s, d):
    return tidy_columns(bar_ops.add_indicators(inputs.bars_wide(s, d)), bar_ops.INDICATORS)


@query("future_return")
def _(s, d):
    return _indicator(bar_ops.future_return(_closes(s, d), 5), "future_return")


@query("label_bars")
def _(s, d):
    return tidy_columns(bar_ops.label_bars(_closes(s, d)), ["future_return"])


@query("label_rows")
def _(s, d):
    keys = inputs.headlines(s, d).select("headline_id", "date", "symbol")
    joined = align.join_bars(keys, _closes(s, d))
    return tidy_columns(bar_ops.label_rows(joined, ("date", "headline_id"), sample=keys), ["future_return"])


@query("label_rows_ticks")
def _(s, d):
    """Every order as a row of its priority: a few symbols with very many rows each."""
    out = bar_ops.label_rows(inputs.ticks(s, d), ("date", "row_id"))
    return tidy_columns(out.select("row_id", "symbol", "future_return", "sentiment_label"), ["future_return"])


@query("label_rows_ticks_5")
def _(s, d):
    out = bar_ops.label_rows(inputs.ticks(s, d), ("date", "row_id"), horizon=5)
    return tidy_columns(out.select("row_id", "symbol", "future_return", "sentiment_label"), ["future_return"])


@query("technical_indicators_ticks")
def _(s, d):
    order = RowOrder(("symbol",), ("date", "row_id"))
    out = bar_ops.add_indicators(inputs.ticks(s, d).withColumn("volume", F.lit(1) + F.col("row_id") % 100), order, fill="none")
    return tidy_columns(out.select("row_id", "symbol", *bar_ops.INDICATORS), bar_ops.INDICATORS)


@query("time_split")
def _(s, d):
    return splits.time_split(inputs.headlines(s, d).select("headline_id", "date", "symbol"))


@query("split_sizes")
def _(s, d):
    return splits.split_sizes(splits.time_split(inputs.headlines(s, d).select("headline_id", "date")))


# ---- text ----------------------------------------------------------------------------------

def _text_query(name, expression):
    @query(name)
    def _(s, d):
        rows = inputs.headlines(s, d).select("headline_id", "headline")
        return rows.select("headline_id", expression(F.col("headline")).alias("text"))


_text_query("clean_urls", lambda t: tx.drop_urls(F.lower(t)))
_text_query("clean_emails", lambda t: tx.drop_emails(F.lower(t)))
_text_query("clean_phones", lambda t: tx.drop_phones(F.lower(t)))
_text_query("clean_mentions", lambda t: tx.drop_mentions(F.lower(t)))
_text_query("clean_hashtags", lambda t: tx.drop_hashtags(F.lower(t)))
_text_query("clean_text", tx.clean_text)
_text_query("tokenize", lambda t: F.array_join(tx.tokenize(tx.clean_text(t)), "|"))
_text_query("remove_stopwords", lambda t: F.array_join(tx.preprocess_tokens(t), "|"))


@query("tokenize_sentences")
def _(s, d):
    found = sentences.tokenize_sentences(inputs.headlines(s, d), "headline", ["headline_id"])
    lines = F.array_join(F.transform("sentences", lambda x: F.array_join(x, "|")), "\n")
    return found.select("headline_id", F.size("sentences").alias("n_sentences"), lines.alias("text"))


@query("lemmatize")
def _(s, d):
    tokens = lexicon.with_tokens(inputs.headlines(s, d), "headline_id", "headline", "tokens")
    out = lemmas.lemmatize(tokens, "tokens", inputs.lemma_exceptions(s), inputs.lemma_vocabulary(s, d), ["headline_id"])
    return out.select("headline_id", F.array_join("lemmas", "|").alias("text"))


def _preprocessed(s, d, join):
    return lemmas.preprocess_lemmas(
        inputs.headlines(s, d).select("headline_id", "headline"), "headline", inputs.lemma_exceptions(s),
        inputs.lemma_vocabulary(s, d), ["headline_id"], join=join)


@query("preprocess_text")
def _(s, d):
    return _preprocessed(s, d, True).select("headline_id", "headline_processed")


@query("preprocess_tokens")
def _(s, d):
    tokens = F.col("headline_processed")
    return _preprocessed(s, d, False).select(
        "headline_id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, "|").alias("tokens"))


@query("entity_flags")
def _(s, d):
    return summary.add_entity_flags(inputs.headlines(s, d).select("headline_id", "headline")).select("headline_id", *tx.ENTITY_FLAGS)


@query("entity_flags_word")
def _(s, d):
    rows = inputs.headlines(s, d).select("headline_id", "headline")
    return summary.add_entity_flags(rows, match="word").select("headline_id", *tx.ENTITY_FLAGS[:3])


@query("entity_counts")
def _(s, d):
    flagged = summary.add_entity_flags(inputs.headlines(s, d).select("symbol", "headline"))
    return flagged.groupBy("symbol").agg(*[F.count_if(f).alias(f.replace("has_", "n_")) for f in tx.ENTITY_FLAGS])


# ---- sentiment models ----------------------------------------------------------------------

def _polarity(s, d):
    return lexicon.polarity(inputs.headlines(s, d), "headline_id", "headline", inputs.lexicon(s))


@query("lexicon_polarity")
def _(s, d):
    return _polarity(s, d).select("headline_id", tidy(F.col("polarity")).alias("polarity"), "n_hits", "y_pred")


@query("lexicon_subjectivity")
def _(s, d):
    return _polarity(s, d).select("headline_id", tidy(F.col("subjectivity")).alias("subjectivity"))


@query("valence_compound")
def _(s, d):
    out = lexicon.valence(inputs.headlines(s, d), "headline_id", "headline", inputs.lexicon(s), inputs.NEGATIONS, inputs.BOOSTERS)
    return tidy_columns(out, ["compound", *models.PROBABILITIES])


@query("valence_rules")
def _(s, d):
    out = valence.valence_rules(inputs.remarks(s, d), "headline_id", "headline", inputs.rule_lexicon(s))
    return tidy_columns(out, ["compound", *models.PROBABILITIES])


def _labelled_texts(s, d):
    labels = inputs.truth(s, d).withColumnRenamed("row_id", "headline_id")
    return inputs.headlines(s, d).select("headline_id", "headline").join(labels, "headline_id")


@query("model_logistic")
def _(s, d):
    fitted = models.fit_logistic(_labelled_texts(s, d), "headline", "y_true")
    scored = models.score_logistic(fitted, inputs.headlines(s, d).select("headline_id", "headline"), "headline_id")
    # coefficients differ between engines; what holds for any is that every row has one distribution and its best class
    p = [F.col(c) for c in models.PROBABILITIES]
    return scored.select("headline_id", F.round(p[0] + p[1] + p[2], 6).alias("p_total"),
                         (F.col("y_pred") == models.best_class(p)).alias("is_best"))


@query("model_nb")
def _(s, d):
    fitted = models.NaiveBayes.fit(_labelled_texts(s, d), "headline", "y_true")
    out = fitted.score(inputs.headlines(s, d), "headline_id", "headline")
    return tidy_columns(out, [*[f"score_{c}" for c in LABELS], *models.PROBABILITIES], 4)


@query("ensemble_vote")
def _(s, d):
    return models.ensemble_vote(inputs.predictions(s, d))


@query("ensemble_mean")
def _(s, d):
    return tidy_columns(models.ensemble_mean(inputs.predictions(s, d)), models.PROBABILITIES)


@query("baseline_majority")
def _(s, d):
    keys = inputs.headlines(s, d).select("headline_id")
    return models.baseline_majority(inputs.truth(s, d), keys, "headline_id", "y_true")


@query("baseline_random")
def _(s, d):
    return models.baseline_random(inputs.headlines(s, d), "headline_id")


@query("plug_in_scorer")
def _(s, d):
    out = models.plug_in_scorer(inputs.headlines(s, d), "headline_id", "headline", inputs.count_scorer)
    return tidy_columns(out, models.PROBABILITIES)


def _exported(s, d):
    """A trained model as arrays: naive Bayes of the labelled texts."""
    return scoring.LinearModel.of_naive_bayes(models.NaiveBayes.fit(_labelled_texts(s, d), "headline", "y_true"))


@query("model_scores")
def _(s, d):
    out = scoring.score_model(inputs.headlines(s, d), "headline_id", "headline", _exported(s, d))
    return tidy_columns(out, models.PROBABILITIES, 4)


# ---- classification metrics ----------------------------------------------------------------

def _counted(s, d):
    return classify.count_metrics(classify.label_counts(inputs.predictions(s, d)))


@query("clf_accuracy")
def _(s, d):
    return tidy_columns(_counted(s, d).select("model", "n", "accuracy"), ["accuracy"])


@query("clf_macro")
def _(s, d):
    names = ["precision_macro", "recall_macro", "f1_macro"]
    return tidy_columns(_counted(s, d).select("model", *names), names)


@query("clf_weighted")
def _(s, d):
    return tidy_columns(_counted(s, d).select("model", "f1_weighted"), ["f1_weighted"])


@query("clf_per_class")
def _(s, d):
    return tidy_columns(_counted(s, d).select("model", *classify.CLASS_METRICS), classify.CLASS_METRICS)


@query("confusion_matrix")
def _(s, d):
    return classify.confusion_matrix(inputs.predictions(s, d))


@query("clf_auc_roc")
def _(s, d):
    return tidy_columns(classify.rank_metrics(inputs.predictions(s, d)).select("model", "auc_roc"), ["auc_roc"])


@query("rank_metrics_ticks")
def _(s, d):
    """Ranking metrics over nearly as many distinct scores as rows."""
    return tidy_columns(classify.rank_metrics(inputs.tick_scores(s, d)), ["auc_roc", "auc_pr"])


@query("clf_auc_pr")
def _(s, d):
    return tidy_columns(classify.rank_metrics(inputs.predictions(s, d)).select("model", "auc_pr"), ["auc_pr"])


def _comparison(s, d):
    keys = inputs.headlines(s, d).select(F.col("headline_id").alias("row_id"), "date", "symbol")
    market = align.join_bars(keys, _closes(s, d))
    return compare.model_comparison(inputs.predictions(s, d), market)


@query("model_comparison")
def _(s, d):
    values = [*classify.MAIN_METRICS, *classify.CLASS_METRICS, *classify.RANK_METRICS,
              *[m for m in strategy.STRATEGY_METRICS if m != "num_trades"]]
    return tidy_columns(_comparison(s, d), values)


@query("metrics_long")
def _(s, d):
    return tidy_columns(compare.report(_comparison(s, d)), ["value"])


# ---- strategy ------------------------------------------------------------------------------

@query("signals")
def _(s, d):
    return strategy.add_signals(inputs.predictions(s, d)).select("model", "row_id", "y_pred", "signal")


RETURN_COLUMNS = ["returns", "strategy_returns"]


@query("strategy_returns")
def _(s, d):
    rows = strategy.strategy_rows(inputs.evaluated_rows(s, d), sample=_row_keys(s, d))
    return tidy_columns(rows.select("model", "row_id", "signal", *RETURN_COLUMNS), RETURN_COLUMNS)


@query("strategy_returns_frame")
def _(s, d):
    rows = strategy.strategy_rows(inputs.evaluated_rows(s, d), signal_scope="frame", sample=_row_keys(s, d))
    return tidy_columns(rows.select("model", "row_id", "signal", *RETURN_COLUMNS), RETURN_COLUMNS)


def _row_keys(s, d):
    """The key and order columns of the evaluated rows, without prices and probabilities."""
    return inputs.evaluated_rows(s, d).select("model", "symbol", "date", "row_id")


def _tidy_metrics(df):
    return tidy_columns(df, [c for c in strategy.STRATEGY_METRICS if c != "num_trades"])


@query("strategy_metrics")
def _(s, d):
    return _tidy_metrics(strategy.strategy_metrics(inputs.evaluated_rows(s, d)).drop("sharpe_simple"))


@query("strategy_metrics_date")
def _(s, d):
    out = strategy.strategy_metrics(inputs.evaluated_rows(s, d), scope="date").drop("sharpe_simple")
    return _tidy_metrics(out)


@query("strategy_simple")
def _(s, d):
    out = strategy.strategy_metrics(inputs.evaluated_rows(s, d))
    names = ["total_return", "volatility", "sharpe_simple", "max_drawdown"]
    return tidy_columns(out.select("model", *names), names)


BAR_RUN = {"by": (), "order_by": ("date",), "daily": True}


@query("strategy_by_symbol")
def _(s, d):
    rows = inputs.bar_predictions(_closes(s, d))
    return _tidy_metrics(strategy.strategy_metrics(rows, scope="symbol", **BAR_RUN).drop("sharpe_simple"))


@query("equity_curve")
def _(s, d):
    evaluated = inputs.evaluated_rows(s, d)
    sample = _row_keys(s, d)
    curve = strategy.strategy_curve(strategy.strategy_rows(evaluated, sample=sample), sample=sample)
    return tidy_columns(curve.select("model", "row_id", "date", "equity", "drawdown"), ["equity", "drawdown"])


@query("drawdown_series")
def _(s, d):
    rows = strategy.strategy_rows(inputs.bar_predictions(_closes(s, d)), **BAR_RUN)
    curve = strategy.strategy_curve(rows, scope="symbol", **BAR_RUN)
    names = ["equity", "peak", "drawdown"]
    return tidy_columns(curve.select("symbol", "date", *names), names)


def _tick_rows(s, d):
    rows = inputs.bar_predictions(inputs.ticks(s, d)).withColumn("model", F.lit("all"))
    return rows.withColumn("close", 100 + (F.col("close") - 100) / 100)


@query("strategy_metrics_ticks")
def _(s, d):
    return _tidy_metrics(strategy.strategy_metrics(_tick_rows(s, d), signal_scope="frame").drop("sharpe_simple"))


@query("strategy_by_symbol_ticks")
def _(s, d):
    return _tidy_metrics(strategy.strategy_metrics(_tick_rows(s, d), scope="symbol").drop("sharpe_simple"))


@query("equity_curve_ticks")
def _(s, d):
    curve = strategy.strategy_curve(materialize(strategy.strategy_rows(_tick_rows(s, d))))
    return tidy_columns(curve.select("row_id", "symbol", "equity", "drawdown"), ["equity", "drawdown"])


def _swing_rows(s, d):
    """Strategy rows on every order, with a signal that lasts for 13 weeks: positions of very many rows."""
    phase = (F.datediff("date", F.lit("1992-01-01").cast("date")) / 91).cast("int") % 3
    preds = F.get(F.array(*[F.lit(c) for c in LABELS]), phase)
    rows = inputs.ticks(s, d).withColumns({"model": F.lit("all"), "y_pred": preds})
    return materialize(strategy.strategy_rows(rows, keep_empty=True))


SWINGS = RowOrder(("model", "symbol"), ("date", "row_id"))


@query("stops_ticks")
def _(s, d):
    out = risk.stops(_swing_rows(s, d), stop_loss=0.0333, take_profit=0.0477, order=SWINGS)
    return tidy_columns(out.select("row_id", "symbol", "stopped_returns"), ["stopped_returns"])


@query("drawdown_limit_ticks")
def _(s, d):
    rows = _tick_rows(s, d).drop("model").withColumn("model", F.col("symbol"))
    rows = materialize(strategy.strategy_rows(rows, keep_empty=True).withColumn("strategy", F.coalesce("strategy_returns", F.lit(0.0))))
    out = risk.drawdown_limit(rows, limit=0.005, order=RowOrder(("model",), ("date", "row_id")))
    return tidy_columns(out.select("row_id", "symbol", "strategy", "limited_returns"), ["strategy", "limited_returns"])


@query("backtest_costs_ticks")
def _(s, d):
    rows = _swing_rows(s, d).withColumn("weight", 0.001 * F.col("signal"))
    return tidy_columns(risk.backtest_costs(rows, order=SWINGS), ["gross", "cost", "capital"])


# ---- declared measures ---------------------------------------------------------------------

def _bar_rows(s, d):
    """Strategy rows on the bars, as model ``all``; every bar is kept."""
    rows = inputs.bar_predictions(_closes(s, d)).withColumn("model", F.lit("all"))
    return strategy.strategy_rows(rows, ("model",), ("date",), daily=True, keep_empty=True)


@query("information_ratio")
def _(s, d):
    return tidy_columns(risk.information_ratio(_bar_rows(s, d)), ["information_ratio"])


@query("alpha_beta")
def _(s, d):
    return tidy_columns(risk.alpha_beta(_bar_rows(s, d)), ["alpha", "beta"])


@query("regression_metrics")
def _(s, d):
    ahead = bar_ops.DAILY.frames(_closes(s, d), 0, 1, lambda x, w: x.withColumn("next", F.lead("close").over(w)))
    out = stats.regression_metrics(ahead, "next", "close", ("symbol",))
    return tidy_columns(out, ["mse", "rmse", "mae", "r2", "mape"])


def _weighted(s, d):
    return risk.position_weights(_bar_rows(s, d), cap=0.3)


@query("position_weights")
def _(s, d):
    return tidy_columns(_weighted(s, d).select("symbol", "date", "signal", "weight"), ["weight"])


@query("rebalance")
def _(s, d):
    return tidy_columns(risk.rebalance(_weighted(s, d), "month").select("symbol", "date", "weight"), ["weight"])


@query("backtest_costs")
def _(s, d):
    out = risk.backtest_costs(risk.rebalance(_weighted(s, d), "week"))
    return tidy_columns(out, ["gross", "cost", "capital"])


@query("stops")
def _(s, d):
    return tidy_columns(risk.stops(_bar_rows(s, d)).select("symbol", "date", "stopped_returns"), ["stopped_returns"])


@query("drawdown_limit")
def _(s, d):
    daily = risk.daily_returns(_bar_rows(s, d)).withColumn("strategy", F.coalesce("strategy", F.lit(0.0)))
    return tidy_columns(risk.drawdown_limit(daily).select("date", "strategy", "limited_returns"),
                        ["strategy", "limited_returns"])


@query("cv_time_series")
def _(s, d):
    folds = splits.cv_time_series(inputs.headlines(s, d).select("headline_id", "date"))
    return folds.select("headline_id", "fold", "part")


@query("cv_purged")
def _(s, d):
    return splits.cv_purged(inputs.headlines(s, d).select("headline_id", "date")).select("headline_id", "fold", "part")


def _scored_rows(s, d):
    """Predictions with their date, whether they hit and how far off they are."""
    dates = inputs.headlines(s, d).select(F.col("headline_id").alias("row_id"), "date")
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    return inputs.predictions(s, d).join(dates, "row_id").select(
        "model", "row_id", "date", hit.alias("hit"), (1 - hit).alias("loss"))


@query("bootstrap_ci")
def _(s, d):
    return tidy_columns(stats.bootstrap_ci(_scored_rows(s, d), "hit", "date"), ["mean", "low", "high"])


@query("paired_t")
def _(s, d):
    return tidy_columns(stats.paired_t(_scored_rows(s, d), "hit", "row_id", "m0", ["m1", "m2"]), ["mean_diff", "t"])


def _differential(s, d):
    return stats.daily_differential(_scored_rows(s, d), "loss", "m2", ["m0", "m1"])


@query("diebold_mariano")
def _(s, d):
    return tidy_columns(stats.diebold_mariano(_differential(s, d)), ["mean_diff", "dm"])


@query("reality_check")
def _(s, d):
    return tidy_columns(stats.reality_check(_differential(s, d)), ["statistic", "p_value"])


@query("feature_table")
def _(s, d):
    heads = inputs.headlines(s, d)
    scored = scoring.score_model(heads, "headline_id", "headline", _exported(s, d)).select(
        "headline_id", (F.col("p_positive") - F.col("p_negative")).alias("model_sentiment"))
    out = features.feature_table(heads, inputs.bars(s, d), inputs.lexicon(s), inputs.NEGATIONS, inputs.BOOSTERS, model_scores=scored)
    out = tidy_columns(out, [*[c for c in features.TEXT_FEATURES if c.startswith("sentiment_")], *features.PRICE_FEATURES])
    return tidy_columns(out, ["model_sentiment"], 4)


# ---- end to end ----------------------------------------------------------------------------

def flagship(s: SparkSession, d: str) -> DataFrame:
    """Label headlines by forward return, split by time, fit, score and compare the baselines."""
    return compare_models(inputs.headlines(s, d), inputs.bars(s, d), inputs.lexicon(s), inputs.NEGATIONS, inputs.BOOSTERS)


@query("baseline_comparison")
def _(s, d):
    out = compare_models(inputs.headlines(s, d), inputs.bars(s, d), inputs.lexicon(s), inputs.NEGATIONS, inputs.BOOSTERS,
                         models=("polarity", "valence", "naive_bayes", "majority"))
    values = [*classify.MAIN_METRICS, *strategy.STRATEGY_METRICS[:1], "hit_rate"]
    return tidy_columns(out.select("model", "n", *values), values)
