"""Exact evaluation metrics over a long predictions table ``(model, label, p)``.

All metrics are computed per model in one pass each:

* confusion cells at a threshold (``p >= t`` is positive) -> precision, recall, F1;
* ROC-AUC with ties sharing credit and average precision (sum of
  (R_n - R_{n-1}) * P_n over distinct scores, not the trapezoid) from
  cumulative counts over distinct scores;
* ROC and PR curve points;
* the 99-threshold sweep via one bucketing pass plus a reverse running sum.

Distinct scores are collapsed first; the cumulative sums use the scalable
``running_sums`` (range-partitioned, no single-task window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.ordering import running_sums

METRIC_COLUMNS = ["precision", "recall", "f1_score", "roc_auc", "pr_auc"]


def _ratio(a: Column, b: Column) -> Column:
    """a / b with 0 when b == 0 (zero-division convention of the metrics)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``model, tn, fp, fn, tp`` at ``p >= threshold``."""
    pos = F.col("p") >= F.lit(threshold)
    y = F.col("label") == 1
    return pred.groupBy("model").agg(
        F.count_if(~y & ~pos).alias("tn"),
        F.count_if(~y & pos).alias("fp"),
        F.count_if(y & ~pos).alias("fn"),
        F.count_if(y & pos).alias("tp"),
    )


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    return precision, recall, f1


def score_counts(pred: DataFrame) -> DataFrame:
    """``model, p, npos, nneg`` per distinct score."""
    return pred.groupBy("model", "p").agg(
        F.count_if(F.col("label") == 1).alias("npos"), F.count_if(F.col("label") != 1).alias("nneg")
    )


def cumulative_by_score(pred: DataFrame) -> DataFrame:
    """Distinct scores in descending order with inclusive cumulative tp/fp per model.

    Output: model, p, npos, nneg, tp, fp, tot_pos, tot_neg.  The input is read
    once (into the distinct-score table); totals are the last cumulative values.
    """
    sc = score_counts(pred)
    cum = running_sums(sc, [F.col("p").desc()], ["npos", "nneg"], group_cols=["model"])
    cum = cum.select("model", "p", "npos", "nneg", F.col("npos_cum").alias("tp"), F.col("nneg_cum").alias("fp"))
    totals = cum.groupBy("model").agg(F.max("tp").alias("tot_pos"), F.max("fp").alias("tot_neg"))
    # one row per model
    return cum.join(F.broadcast(totals), "model")


def _auc_expr() -> Column:
    below = F.col("tot_neg") - F.col("fp")
    return F.try_divide(F.sum(F.col("npos") * (below + F.col("nneg") / 2.0)), F.max("tot_pos").cast("double") * F.max("tot_neg"))


def _ap_expr() -> Column:
    return F.sum(_ratio(F.col("npos"), F.col("tot_pos")) * _ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def auc_ap(pred: DataFrame) -> DataFrame:
    """``model, roc_auc, pr_auc`` (unrounded).

    AUC = sum over scores of npos * (negatives below + nneg/2) / (P*N);
    AP  = sum over scores of (npos/P) * tp/(tp+fp).
    """
    return cumulative_by_score(pred).groupBy("model").agg(_auc_expr().alias("roc_auc"), _ap_expr().alias("pr_auc"))


def evaluate(pred: DataFrame, threshold: float = 0.5, digits: int | None = 4) -> DataFrame:
    """Metrics table per model: threshold, precision, recall, f1_score, roc_auc, pr_auc, tn, fp, fn, tp.

    Confusion cells, AUC and AP come from one aggregation over the distinct-score table.
    """
    at = F.col("p") >= F.lit(threshold)
    agg = cumulative_by_score(pred).groupBy("model").agg(
        F.sum(F.when(at, F.col("npos")).otherwise(F.lit(0))).alias("_tp"),
        F.sum(F.when(at, F.col("nneg")).otherwise(F.lit(0))).alias("_fp"),
        F.max("tot_pos").alias("_P"),
        F.max("tot_neg").alias("_N"),
        _auc_expr().alias("roc_auc"),
        _ap_expr().alias("pr_auc"),
    )
    tp, fp = F.col("_tp"), F.col("_fp")
    fn, tn = F.col("_P") - tp, F.col("_N") - fp
    p, r, f = prf(tp, fp, fn)
    rnd = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return agg.select(
        F.col("model").alias("model_name"),
        F.lit(float(threshold)).alias("threshold"),
        rnd(p).alias("precision"),
        rnd(r).alias("recall"),
        rnd(f).alias("f1_score"),
        rnd(F.col("roc_auc")).alias("roc_auc"),
        rnd(F.col("pr_auc")).alias("pr_auc"),
        tn.cast("bigint").alias("tn"),
        fp.cast("bigint").alias("fp"),
        fn.cast("bigint").alias("fn"),
        tp.cast("bigint").alias("tp"),
    )


def metrics_record(metrics: DataFrame, evaluated_at: Column | None = None) -> DataFrame:
    """Metrics with the 2x2 confusion matrix array and an evaluation stamp (JSON sink form)."""
    return metrics.select(
        "*",
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
        (evaluated_at if evaluated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias(
            "evaluated_at"
        ),
    )


def roc_points(pred: DataFrame) -> DataFrame:
    """ROC curve: ``model, score, fpr, tpr`` at every distinct score, plus the (0, 0) start (score = +inf)."""
    c = cumulative_by_score(pred)
    pts = c.select(
        "model", F.col("p").alias("score"), _ratio(F.col("fp"), F.col("tot_neg")).alias("fpr"), _ratio(F.col("tp"), F.col("tot_pos")).alias("tpr")
    )
    start = pred.select("model").distinct().select("model", F.lit(float("inf")).alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_points(pred: DataFrame) -> DataFrame:
    """PR curve: ``model, score, precision, recall`` per distinct score, plus the (recall 0, precision 1) end."""
    c = cumulative_by_score(pred)
    pts = c.select(
        "model",
        F.col("p").alias("score"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tot_pos")).alias("recall"),
    )
    end = pred.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("score"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return pts.unionByName(end)


# Sweep thresholds: numpy linspace(0.01, 0.99, 99): j*step + 0.01, the last one exactly 0.99.
SWEEP_START, SWEEP_STOP, SWEEP_N = 0.01, 0.99, 99


def sweep_threshold(j: Column) -> Column:
    step = (SWEEP_STOP - SWEEP_START) / (SWEEP_N - 1)
    return F.when(j == SWEEP_N - 1, F.lit(SWEEP_STOP)).otherwise(j.cast("double") * F.lit(step) + F.lit(SWEEP_START))


def threshold_sweep(pred: DataFrame) -> DataFrame:
    """Precision/recall/F1 at the 99 thresholds 0.01..0.99 per model.

    Each row goes to bucket j* = largest j with t_j <= p (-1 if none), found in
    O(1) from the float formula with an exact +-1 correction, so there is no
    rows x thresholds product.  tp(t_j) = positives in buckets >= j.
    Output: model, j, threshold, tp, fp, fn, precision, recall, f1.
    """
    step = (SWEEP_STOP - SWEEP_START) / (SWEEP_N - 1)
    p = F.col("p")
    j0 = F.floor((p - F.lit(SWEEP_START)) / F.lit(step)).cast("int")
    j0 = F.least(F.greatest(j0, F.lit(-1)), F.lit(SWEEP_N - 1))
    up = F.least(j0 + 1, F.lit(SWEEP_N - 1))
    jstar = (
        F.when((up > j0) & (sweep_threshold(up) <= p), up)
        .when((j0 >= 0) & (sweep_threshold(j0) <= p), j0)
        .otherwise(j0 - 1)
    )
    jstar = F.greatest(jstar, F.lit(-1))
    buckets = pred.select("model", "label", jstar.alias("j")).groupBy("model", "j").agg(
        F.count_if(F.col("label") == 1).alias("bpos"), F.count_if(F.col("label") != 1).alias("bneg")
    )
    # full 0..98 grid per model (models x 99 rows), filled from the bucket counts
    grid = buckets.select("model").distinct().select("model", F.explode(F.sequence(F.lit(-1), F.lit(SWEEP_N - 1))).alias("j"))
    full = grid.join(buckets, ["model", "j"], "left").fillna(0, subset=["bpos", "bneg"])
    rev = Window.partitionBy("model").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    allw = Window.partitionBy("model")  # <= 100 rows per model
    full = full.select(
        "model",
        "j",
        F.sum("bpos").over(rev).alias("tp"),
        F.sum("bneg").over(rev).alias("fp"),
        F.sum("bpos").over(allw).alias("tot_pos"),
    ).filter(F.col("j") >= 0)
    fn = F.col("tot_pos") - F.col("tp")
    pr, rc, f1 = prf(F.col("tp"), F.col("fp"), fn)
    return full.select(
        "model",
        F.col("j").cast("int").alias("j"),
        sweep_threshold(F.col("j")).alias("threshold"),
        F.col("tp").cast("bigint").alias("tp"),
        F.col("fp").cast("bigint").alias("fp"),
        fn.cast("bigint").alias("fn"),
        pr.alias("precision"),
        rc.alias("recall"),
        f1.alias("f1"),
    )


def best_f1_threshold(sweep: DataFrame) -> DataFrame:
    """First threshold reaching the maximum F1 per model: ``model, best_threshold, best_f1``."""
    w = Window.partitionBy("model").orderBy(F.col("f1").desc(), F.col("j").asc())
    return (
        sweep.withColumn("_r", F.row_number().over(w))
        .filter("_r = 1")
        .select("model", F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1"))
    )


def minmax_normalise(df: DataFrame, col: str, out: str, by: str | None = None) -> DataFrame:
    """(x - min) / (max - min + 1e-9), per ``by`` group (decision scores without probabilities).

    The per-group min/max (one row per model) are collected and inlined as literals.
    """
    keys = [by] if by else []
    rows = df.groupBy(*keys).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx")).collect()
    if by:
        mn = F.create_map(*[x for r in rows for x in (F.lit(r[by]), F.lit(r["_mn"]))])[F.col(by)]
        mx = F.create_map(*[x for r in rows for x in (F.lit(r[by]), F.lit(r["_mx"]))])[F.col(by)]
    else:
        mn, mx = F.lit(rows[0]["_mn"]), F.lit(rows[0]["_mx"])
    return df.withColumn(out, (F.col(col) - mn) / (mx - mn + F.lit(1e-9)))


def best_by_recall(metrics: DataFrame, order_col: str = "position") -> DataFrame:
    """The model with the highest recall; on a tie the first listed one wins."""
    w = Window.orderBy(F.col("recall").desc(), F.col(order_col).asc())  # one row per model
    return metrics.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def highlight_max(metrics: DataFrame, cols=tuple(METRIC_COLUMNS)) -> DataFrame:
    """Boolean ``is_max_<col>`` marking the column-wise maximum (all tied maxima are marked)."""
    allw = Window.partitionBy()  # metrics tables have one row per model
    return metrics.select("*", *[(F.col(c) == F.max(c).over(allw)).alias(f"is_max_{c}") for c in cols])


def metrics_long(metrics: DataFrame, cols=tuple(METRIC_COLUMNS)) -> DataFrame:
    """Wide -> long: ``model_name, metric, value``."""
    return metrics.unpivot(["model_name"], list(cols), "metric", "value")
