import random

import pytest

from quillbar.functions.fixed_values import LABELS
from quillbar.operators import classify, compare

PAIRS = [("positive", "positive"), ("negative", "negative"), ("neutral", "neutral"), ("positive", "neutral"), ("negative", "negative")]


def table(spark, pairs, model="m"):
    rows = [(model, i, t, p) for i, (t, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "model string, row_id long, y_true string, y_pred string")


def test_five_rows(spark):
    df = table(spark, PAIRS)
    m = classify.classification_metrics(df, probabilities=False).first()
    assert m["accuracy"] == pytest.approx(0.8) and m["f1_weighted"] == pytest.approx(0.8)
    assert m["precision_macro"] == pytest.approx(5 / 6) == m["recall_macro"]
    assert m["f1_macro"] == pytest.approx(7 / 9)
    assert [m[f"f1_{c}"] for c in LABELS] == pytest.approx([1, 2 / 3, 2 / 3])
    assert classify.metrics_matrix(df).first()["confusion_matrix"] == [[2, 0, 0], [0, 1, 0], [0, 1, 1]]


def test_absent_class_is_left_out(spark):
    m = classify.classification_metrics(table(spark, [("positive", "positive"), ("negative", "positive")]), probabilities=False).first()
    assert m["precision_neutral"] is None and m["f1_neutral"] is None
    assert m["precision_negative"] == 0.0 and m["precision_positive"] == 0.5
    assert m["precision_macro"] == pytest.approx(0.25) and m["f1_macro"] == pytest.approx((0 + 2 / 3) / 2)


def test_unknown_labels(spark):
    df = table(spark, [*PAIRS, ("positive", "great"), (None, "positive")])
    with pytest.raises(Exception, match="unknown label"):
        classify.label_counts(df).collect()
    assert classify.classification_metrics(df, probabilities=False, mode="permissive").first()["n"] == 5


def scored(spark, n=240, seed=2, classes=LABELS):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rng.randrange(1, 6) for _ in LABELS]
        rows.append(("m", i, rng.choice(classes), rng.choice(LABELS), *[x / sum(w) for x in w]))
    return rows, spark.createDataFrame(rows, "model string, row_id long, y_true string, y_pred string, " + ", ".join(f"p_{c} double" for c in LABELS))


@pytest.mark.parametrize("layout", [{}, {"ranges": 5, "smallest_sample": 30}])
def test_ranking_against_all_pairs(spark, layout):
    rows, df = scored(spark)
    roc, pr = [], []
    for k, c in enumerate(LABELS):
        pos = [r[4 + k] for r in rows if r[2] == c]
        neg = [r[4 + k] for r in rows if r[2] != c]
        roc.append(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)))
        area, last = 0.0, 0.0
        for cut in sorted({*pos, *neg}, reverse=True):
            tp, fp = sum(p >= cut for p in pos), sum(q >= cut for q in neg)
            area += (tp / len(pos) - last) * tp / (tp + fp)
            last = tp / len(pos)
        pr.append(area)
    got = classify.rank_metrics(df, **layout).first()
    assert got["auc_roc"] == pytest.approx(sum(roc) / 3, abs=1e-12)
    assert got["auc_pr"] == pytest.approx(sum(pr) / 3, abs=1e-12)


def test_ranking_needs_every_class(spark):
    got = classify.rank_metrics(scored(spark, classes=LABELS[:2])[1]).first()
    assert got["auc_roc"] is None and got["auc_pr"] is None


def test_comparison_is_sorted_and_reported(spark):
    rows, df = scored(spark)
    better = df.withColumn("model", df.model).replace("m", "n", "model").withColumn("y_pred", df.y_true)
    out = compare.model_comparison(df.unionByName(better))
    assert [r["model"] for r in out.collect()] == ["n", "m"]
    report = compare.report(out).where("model = 'n'").orderBy("position").collect()
    assert [r["metric"] for r in report] == classify.MAIN_METRICS and report[0]["value"] == 1.0


def test_permissive_mode_ranks_the_rows_it_keeps(spark):
    rows = [("m", "positive", "positive", 0.1, 0.2, 0.7), ("m", "neutral", "neutral", 0.2, 0.6, 0.2),
            ("m", "negative", "negative", 0.8, 0.1, 0.1), ("m", "unheard", "positive", 0.3, 0.3, 0.4)]
    df = spark.createDataFrame(rows, "model string, y_true string, y_pred string, p_negative double, p_neutral double, p_positive double")
    got = classify.classification_metrics(df, mode="permissive").first()
    assert (got["n"], got["auc_roc"], got["auc_pr"]) == (3, 1.0, 1.0)
