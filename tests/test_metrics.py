import math

import pytest
from pyspark.sql import functions as F

from txrisk.operators import metrics


def _pred(spark, pairs, model="m"):
    return spark.createDataFrame([(model, i, y, float(p)) for i, (y, p) in enumerate(pairs)], "model string, id long, label int, p double")


def _brute_auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y != 1]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _brute_ap(pairs):
    P = sum(1 for y, _ in pairs if y == 1)
    ap = 0.0
    for t in sorted({p for _, p in pairs}, reverse=True):
        tp = sum(1 for y, p in pairs if p >= t and y == 1)
        fp = sum(1 for y, p in pairs if p >= t and y != 1)
        npos = sum(1 for y, p in pairs if p == t and y == 1)
        ap += npos / P * tp / (tp + fp)
    return ap


def test_tied_scores_average_precision(spark):
    pairs = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.1)]
    r = metrics.auc_ap(_pred(spark, pairs)).first()
    assert round(r["pr_auc"], 4) == 0.7556
    assert r["roc_auc"] == pytest.approx(_brute_auc(pairs))


def test_random_tables_against_brute_force(spark):
    import random

    rng = random.Random(3)
    pairs = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(400)]
    r = metrics.auc_ap(_pred(spark, pairs)).first()
    assert r["roc_auc"] == pytest.approx(_brute_auc(pairs), abs=1e-12)
    assert r["pr_auc"] == pytest.approx(_brute_ap(pairs), abs=1e-12)


def test_one_class_and_no_predicted_positives(spark):
    pairs = [(0, 0.1), (0, 0.2), (0, 0.3)]
    m = metrics.evaluate(_pred(spark, pairs), 0.5).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (3, 0, 0, 0)
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1_score"] == 0.0
    assert m["roc_auc"] is None  # undefined with one class


@pytest.mark.parametrize(
    "cells,prf",
    [
        ((54884, 1980, 11, 87), (0.0421, 0.8878, 0.0804)),
        ((56854, 10, 21, 77), (0.8851, 0.7857, 0.8324)),
        ((56667, 197, 16, 82), (0.2939, 0.8367, 0.435)),
    ],
)
def test_published_cells_give_published_scores(spark, cells, prf):
    tn, fp, fn, tp = cells
    df = spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")
    p, r, f = metrics.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    row = df.select(F.round(p, 4).alias("p"), F.round(r, 4).alias("r"), F.round(f, 4).alias("f")).first()
    assert (row["p"], row["r"], row["f"]) == prf


def test_threshold_sweep_matches_direct_counts(spark):
    import numpy as np

    pairs = [(i % 3 == 0, round(i / 200.0, 3)) for i in range(201)]
    pred = _pred(spark, [(int(y), p) for y, p in pairs])
    sw = {r["j"]: r for r in metrics.threshold_sweep(pred).collect()}
    ths = np.linspace(0.01, 0.99, 99)
    assert len(sw) == 99
    for j, t in enumerate(ths):
        tp = sum(1 for y, p in pairs if p >= t and y)
        fp = sum(1 for y, p in pairs if p >= t and not y)
        assert sw[j]["threshold"] == t
        assert (sw[j]["tp"], sw[j]["fp"]) == (tp, fp)
    best = metrics.best_f1_threshold(metrics.threshold_sweep(pred)).first()
    f1s = [sw[j]["f1"] for j in range(99)]
    assert best["best_threshold"] == ths[int(np.argmax(f1s))]


def test_curves_start_and_end_points(spark):
    pairs = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.1)]
    roc = metrics.roc_points(_pred(spark, pairs)).orderBy(F.col("score").desc()).collect()
    assert (roc[0]["fpr"], roc[0]["tpr"]) == (0.0, 0.0) and (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0)
    pr = metrics.pr_points(_pred(spark, pairs)).collect()
    assert any(r["score"] is None and r["precision"] == 1.0 and r["recall"] == 0.0 for r in pr)


def test_minmax_normalise(spark):
    df = spark.createDataFrame([("a", -2.0), ("a", 2.0), ("a", 0.0)], "m string, s double")
    out = {r["s"]: r["p"] for r in metrics.minmax_normalise(df, "s", "p", by="m").collect()}
    assert out[-2.0] == 0.0 and math.isclose(out[2.0], 4 / (4 + 1e-9)) and math.isclose(out[0.0], 2 / (4 + 1e-9))


def test_best_by_recall_first_wins_on_tie(spark):
    df = spark.createDataFrame([("A", 0.5, 0), ("B", 0.9, 1), ("C", 0.9, 2)], "model_name string, recall double, position int")
    assert metrics.best_by_recall(df).first()["model_name"] == "B"


def test_auc_of_huge_counts_does_not_overflow(spark):
    from pyspark.sql import functions as F

    from txrisk.operators.metrics import _auc_expr

    rows = [(170_000_000, 0, 170_000_000, 0), (0, 100_000_000_000, 170_000_000, 100_000_000_000)]
    df = spark.createDataFrame([(*r, 170_000_000, 100_000_000_000) for r in rows], "npos long, nneg long, tp long, fp long, tot_pos long, tot_neg long")
    assert df.agg(_auc_expr().alias("a")).first().a == 1.0
