"""Registered queries: name -> (Spark callable, DuckDB oracle SQL or None).

Every query reads the driver tables of ``sf_dir`` (or data Spark derives from
them) in full.  Doubles are reported rounded to 6 decimals on both sides so the
comparison does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import oracle as O
from txrisk.functions import risk as R
from txrisk.functions.hashing import draw, sql_draw, sql_uniform
from txrisk.operators import cleaning, eda, features, metrics, moments, ordering, stats
from txrisk.schema import ALERT_METADATA
from txrisk.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def report_round(c, digits: int) -> F.Column:
    """floor(x * 10^d + 0.5) / 10^d in doubles: the same IEEE steps as the oracle SQL (``oracle.r6``)."""
    scale = float(10**digits)
    finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(finite, F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)).otherwise(c)


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Report-round every double column; ``per_column`` overrides the digits."""
    types = dict(df.dtypes)
    return df.select(
        *[
            report_round(F.col(c), per_column.get(c, digits)).alias(c) if types[c] in ("double", "float") else F.col(c)
            for c in df.columns
        ]
    )


r6 = O.r6

# ---------------------------------------------------------------------------
# Profiling
# ---------------------------------------------------------------------------


@register(
    "fraud_rate_by_hour",
    O.with_tx(
        f"""
SELECT CAST(floor(fmod(Time / 3600.0, 24.0)) AS INTEGER) AS hour_int,
       {r6('avg(Class)')} AS fraud_rate,
       count(*) AS count,
       avg(Class) > 0.005 AS highlighted
FROM tx GROUP BY 1"""
    ),
)
def q_fraud_rate_by_hour(spark, sf_dir):
    return rounded(eda.fraud_rate_by_hour(tables.transactions(spark, sf_dir)))


_STATS_SQL = f"""
SELECT count(*) AS total_transactions,
       CAST(sum(Class) AS BIGINT) AS fraud_count,
       CAST(count(*) - sum(Class) AS BIGINT) AS legitimate_count,
       round(sum(Class) / count(*) * 100.0, 4) AS fraud_rate_pct,
       round((count(*) - sum(Class)) / greatest(sum(Class), 1), 1) AS imbalance_ratio,
       CAST(count(Amount) AS DOUBLE) AS amount_count,
       {r6('avg(Amount)')} AS amount_mean,
       {r6('stddev_samp(Amount)')} AS amount_std,
       {r6('min(Amount)')} AS amount_min,
       {r6('quantile_cont(Amount, 0.25)')} AS amount_p25,
       {r6('quantile_cont(Amount, 0.5)')} AS amount_p50,
       {r6('quantile_cont(Amount, 0.75)')} AS amount_p75,
       {r6('max(Amount)')} AS amount_max,
       round((max(Time) - min(Time)) / 3600.0, 1) AS time_range_hours
FROM tx"""


@register("dataset_stats", O.with_tx(_STATS_SQL))
def q_dataset_stats(spark, sf_dir):
    return rounded(stats.dataset_stats(tables.transactions(spark, sf_dir)))


@register("dataset_stats_lineitem", O.with_tx_li(_STATS_SQL))
def q_dataset_stats_li(spark, sf_dir):
    return rounded(stats.dataset_stats(tables.transactions_li(spark, sf_dir)))


@register(
    "class_counts",
    O.with_tx(
        f"""
, c AS (SELECT k AS Class, (SELECT count(*) FROM tx WHERE tx.Class = k) AS count FROM (VALUES (0), (1)) t(k))
SELECT CAST(Class AS INTEGER) AS Class, CAST(count AS BIGINT) AS count,
       {r6('round(count / (SELECT sum(count) FROM c) * 100.0, 3)')} AS share_pct
FROM c"""
    ).replace("\n, c AS", ",\nc AS"),
)
def q_class_counts(spark, sf_dir):
    return rounded(eda.class_counts(tables.transactions(spark, sf_dir)))


@register(
    "hourly_volume",
    O.with_tx(
        """
SELECT CAST(floor(Time / 3600.0) AS BIGINT) AS time_bin, count(*) AS total,
       CAST(sum(Class) AS BIGINT) AS fraud, CAST(count(*) - sum(Class) AS BIGINT) AS legit
FROM tx GROUP BY 1"""
    ),
)
def q_hourly_volume(spark, sf_dir):
    return eda.hourly_volume(tables.transactions(spark, sf_dir))


@register(
    "hourly_volume_lineitem",
    O.with_tx_li(
        """
SELECT CAST(floor(Time / 3600.0) AS BIGINT) AS time_bin, count(*) AS total,
       CAST(sum(Class) AS BIGINT) AS fraud, CAST(count(*) - sum(Class) AS BIGINT) AS legit
FROM tx GROUP BY 1"""
    ),
)
def q_hourly_volume_li(spark, sf_dir):
    return eda.hourly_volume(tables.transactions_li(spark, sf_dir))


_HIST_SQL = f"""
, mm AS (SELECT log10(greatest(min(Amount), 0.01)) AS lo, log10(max(Amount)) AS hi FROM tx),
e AS (SELECT list_transform(range(0, 50), lambda i: pow(10.0, CASE WHEN i = 49 THEN hi ELSE i * ((hi - lo) / 49.0) + lo END)) AS edges FROM mm),
b AS (
  SELECT Class, least(len(list_filter(edges, lambda x: x <= Amount)) - 1, 48) AS bin, edges
  FROM tx, e
),
c AS (SELECT Class, bin, count(*) AS count, any_value(edges) AS edges FROM b WHERE bin >= 0 GROUP BY Class, bin)
SELECT CAST(Class AS INTEGER) AS Class, CAST(bin AS INTEGER) AS bin,
       {r6('edges[bin + 1]')} AS lo, {r6('edges[bin + 2]')} AS hi, count,
       {r6('count / (sum(count) OVER (PARTITION BY Class) * (edges[bin + 2] - edges[bin + 1]))', 8)} AS density
FROM c"""


@register("amount_histogram", O.with_tx(_HIST_SQL).replace("\n, mm AS", ",\nmm AS"))
def q_amount_histogram(spark, sf_dir):
    return rounded(eda.amount_histogram(tables.transactions(spark, sf_dir)), density=8)


@register("amount_histogram_lineitem", O.with_tx_li(_HIST_SQL).replace("\n, mm AS", ",\nmm AS"))
def q_amount_histogram_li(spark, sf_dir):
    return rounded(eda.amount_histogram(tables.transactions_li(spark, sf_dir)), density=8)


_BOX_SQL = f"""
, cap AS (SELECT Class, quantile_cont(Amount, 0.99) AS cap FROM tx WHERE Amount IS NOT NULL GROUP BY Class),
v AS (SELECT tx.Class, least(Amount, cap) AS v FROM tx JOIN cap USING (Class) WHERE Amount IS NOT NULL),
q AS (SELECT Class, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM v GROUP BY Class),
w AS (SELECT q.*, q1 - 1.5 * (q3 - q1) AS lo_, q3 + 1.5 * (q3 - q1) AS hi_ FROM q)
SELECT CAST(w.Class AS INTEGER) AS Class, n, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3,
       {r6('min(v) FILTER (WHERE v >= lo_ AND v <= hi_)')} AS whislo,
       {r6('max(v) FILTER (WHERE v >= lo_ AND v <= hi_)')} AS whishi,
       count(*) FILTER (WHERE NOT (v >= lo_ AND v <= hi_)) AS n_fliers
FROM w JOIN v USING (Class)
GROUP BY w.Class, n, q1, median, q3"""


@register("amount_boxplot", O.with_tx(_BOX_SQL).replace("\n, cap AS", ",\ncap AS"))
def q_amount_boxplot(spark, sf_dir):
    return rounded(eda.amount_boxplot(tables.transactions(spark, sf_dir)))


@register("amount_boxplot_lineitem", O.with_tx_li(_BOX_SQL).replace("\n, cap AS", ",\ncap AS"))
def q_amount_boxplot_li(spark, sf_dir):
    return rounded(eda.amount_boxplot(tables.transactions_li(spark, sf_dir)))


@register(
    "score_histogram",
    O.with_pred(
        f"""
, b AS (SELECT model, label, CAST(least(floor(p * 100.0 / 2.0), 49) AS INTEGER) AS bin
       FROM pred WHERE p * 100.0 >= 0 AND p * 100.0 <= 100),
c AS (SELECT model, label, bin, count(*) AS count FROM b GROUP BY ALL)
SELECT model, label, bin, count, {r6('count / (sum(count) OVER (PARTITION BY model, label) * 2.0)')} AS density FROM c"""
    ).replace("\n, b AS", ",\nb AS"),
)
def q_score_histogram(spark, sf_dir):
    return rounded(eda.score_histogram(tables.predictions(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Cleaning and features
# ---------------------------------------------------------------------------

_ALL = ", ".join(["id", "Time", "Amount", "Class"] + [f"V{i}" for i in range(1, 29)])


@register(
    "clean_transactions",
    O.with_tx(f"SELECT {', '.join(['id', 'Class'] + [O.r6(c) + ' AS ' + c for c in ['Time', 'Amount'] + [f'V{i}' for i in range(1, 29)]])} FROM tx WHERE Class IN (0, 1)"),
)
def q_clean(spark, sf_dir):
    tx = tables.transactions(spark, sf_dir)
    return rounded(cleaning.clean(tx))


def dirty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with null, NaN and infinite cells and invalid labels, placed by id."""
    every = lambda n: F.col("id") % n == 0
    tx = tables.transactions(spark, sf_dir).select("id", "Class", "Time", "Amount", "V1", "V2", "V3")
    amount = F.when(every(11), F.lit(float("nan"))).when(every(13), F.lit(float("inf"))).when(~every(17), F.col("Amount"))
    label = F.when(every(19), F.lit(2)).when(every(29), F.lit(-1)).when(~every(23), F.col("Class"))
    return tx.withColumns({"Amount": amount, "V1": F.when(~every(5), F.col("V1")), "V2": F.when(every(7), F.lit(float("-inf"))).otherwise(F.col("V2")), "Class": label})


# the same cells with null for every value that is not finite
_DIRTY_CTE = """
, d AS (
  SELECT id, Time, V3,
         CASE WHEN id % 11 = 0 OR id % 13 = 0 OR id % 17 = 0 THEN NULL ELSE Amount END AS Amount,
         CASE WHEN id % 5 = 0 THEN NULL ELSE V1 END AS V1, CASE WHEN id % 7 = 0 THEN NULL ELSE V2 END AS V2,
         CASE WHEN id % 19 = 0 THEN 2 WHEN id % 29 = 0 THEN -1 WHEN id % 23 = 0 THEN NULL ELSE Class END AS Class
  FROM tx
)"""


@register(
    "clean_dirty_transactions",
    O.with_tx(
        _DIRTY_CTE
        + f""",
v AS (SELECT * FROM d WHERE Class IN (0, 1)),
m AS (SELECT quantile_cont(Amount, 0.5) AS a, quantile_cont(V1, 0.5) AS b, quantile_cont(V2, 0.5) AS c FROM v)
SELECT id, Class, {r6('Time')} AS Time, {r6('coalesce(Amount, a)')} AS Amount, {r6('coalesce(V1, b)')} AS V1, {r6('coalesce(V2, c)')} AS V2, {r6('V3')} AS V3
FROM v, m"""
    ).replace("\n, d AS", ",\nd AS"),
)
def q_clean_dirty(spark, sf_dir):
    # non-finite cells, then invalid labels, then medians of the rows that are left
    return rounded(cleaning.clean(dirty_transactions(spark, sf_dir)))


@register(
    "records_missing_as_zero",
    O.with_tx(
        _DIRTY_CTE
        + f"""
SELECT id, {r6('coalesce(V1, 0.0)')} AS V1, {r6('coalesce(V2, 0.0)')} AS V2, CAST(0.0 AS DOUBLE) AS V3, CAST(0.0 AS DOUBLE) AS tx_velocity FROM d"""
    ).replace("\n, d AS", ",\nd AS"),
)
def q_missing_as_zero(spark, sf_dir):
    # records with null cells, without V3 and without a rolling feature
    recs = cleaning.nonfinite_to_null(dirty_transactions(spark, sf_dir)).drop("V3")
    full = cleaning.fill_missing_columns(cleaning.null_to_zero(recs, ["V1", "V2"]), ["V1", "V2", "V3", "tx_velocity"])
    return rounded(full.select("id", "V1", "V2", "V3", "tx_velocity"))


_FEAT_CTES = """
, s AS (
  SELECT quantile_cont(Amount, 0.5) AS med,
         CASE WHEN quantile_cont(Amount, 0.75) - quantile_cont(Amount, 0.25) = 0 THEN 1.0
              ELSE quantile_cont(Amount, 0.75) - quantile_cont(Amount, 0.25) END AS iqr,
         quantile_cont(Amount, 0.95) AS q95,
         avg(Time / 3600.0) AS hm, stddev_samp(Time / 3600.0) AS hs
  FROM tx
),
f AS (
  SELECT tx.*, (Amount - med) / iqr AS Amount_scaled,
         Time / 3600.0 AS Time_hours,
         (Time / 3600.0 - hm) / hs AS Time_scaled,
         fmod(Time / 3600.0, 24.0) AS hod,
         CAST(Amount > q95 AS INTEGER) AS is_high_amount,
         V14 * V17 AS V14_V17_interaction, V4 * V11 AS V4_V11_interaction,
         CAST(least(row_number() OVER (ORDER BY Time, id), 100) AS DOUBLE) AS tx_velocity,
         avg(Amount) OVER (ORDER BY Time, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS rolling_avg_amount
  FROM tx, s
),
g AS (
  SELECT f.*, sin(2 * pi() * hod / 24.0) AS hour_sin, cos(2 * pi() * hod / 24.0) AS hour_cos,
         abs(Amount - rolling_avg_amount) AS amount_deviation
  FROM f
)"""

_FEAT_SQL = _FEAT_CTES + f"""
SELECT id, {r6('Amount_scaled')} AS Amount_scaled, {r6('Time_hours')} AS Time_hours, {r6('Time_scaled')} AS Time_scaled,
       {r6('hour_sin')} AS hour_sin, {r6('hour_cos')} AS hour_cos,
       tx_velocity, {r6('rolling_avg_amount', 8)} AS rolling_avg_amount,
       {r6('amount_deviation', 8)} AS amount_deviation, is_high_amount,
       {r6('V14_V17_interaction')} AS V14_V17_interaction, {r6('V4_V11_interaction')} AS V4_V11_interaction
FROM g"""

ENGINEERED_OUT = [
    "id",
    "Amount_scaled",
    "Time_hours",
    "Time_scaled",
    "hour_sin",
    "hour_cos",
    "tx_velocity",
    "rolling_avg_amount",
    "amount_deviation",
    "is_high_amount",
    "V14_V17_interaction",
    "V4_V11_interaction",
]


@register("engineered_features", O.with_tx(_FEAT_SQL).replace("\n, s AS", ",\ns AS"))
def q_engineered(spark, sf_dir):
    out, _ = features.engineer_features(tables.transactions(spark, sf_dir))
    # frame means of <= 100 two-decimal amounts terminate within 8 decimals: no rounding ties there
    return rounded(out.select(*ENGINEERED_OUT), rolling_avg_amount=8, amount_deviation=8)


# ---------------------------------------------------------------------------
# Evaluation metrics
# ---------------------------------------------------------------------------

_CUM_SQL = """
, sc AS (SELECT model, p, count(*) FILTER (WHERE label = 1) AS npos, count(*) FILTER (WHERE label <> 1) AS nneg
        FROM pred GROUP BY model, p),
cum AS (
  SELECT model, p, npos, nneg,
         sum(npos) OVER (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
         sum(nneg) OVER (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
         sum(npos) OVER (PARTITION BY model) AS tot_pos, sum(nneg) OVER (PARTITION BY model) AS tot_neg
  FROM sc
)"""


def _cum(body: str) -> str:
    return O.with_pred(_CUM_SQL + body).replace("\n, sc AS", ",\nsc AS")


@register(
    "model_metrics",
    _cum(
        """,
auc AS (
  SELECT model, sum(npos * ((tot_neg - fp) + nneg / 2.0)) / (any_value(tot_pos) * any_value(tot_neg)) AS roc_auc,
         sum(CASE WHEN tot_pos = 0 THEN 0 ELSE npos / tot_pos END * CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END) AS pr_auc
  FROM cum GROUP BY model
),
cm AS (
  SELECT model, count(*) FILTER (WHERE label <> 1 AND p < 0.5) AS tn, count(*) FILTER (WHERE label <> 1 AND p >= 0.5) AS fp,
         count(*) FILTER (WHERE label = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND p >= 0.5) AS tp
  FROM pred GROUP BY model
)
SELECT cm.model AS model_name, CAST(0.5 AS DOUBLE) AS threshold,
       round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 4) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 4) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1_score,
       round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc, tn, fp, fn, tp
FROM cm LEFT JOIN auc USING (model)"""
    ),
)
def q_model_metrics(spark, sf_dir):
    return rounded(metrics.evaluate(tables.predictions(spark, sf_dir), 0.5))


@register(
    "roc_points",
    _cum(
        f"""
SELECT model, p AS score, {r6('CASE WHEN tot_neg = 0 THEN 0 ELSE fp / tot_neg END')} AS fpr, {r6('CASE WHEN tot_pos = 0 THEN 0 ELSE tp / tot_pos END')} AS tpr FROM cum
UNION ALL
SELECT DISTINCT model, 'inf'::DOUBLE, 0.0, 0.0 FROM pred"""
    ),
)
def q_roc_points(spark, sf_dir):
    return rounded(metrics.roc_points(tables.predictions(spark, sf_dir)))


@register(
    "pr_points",
    _cum(
        f"""
SELECT model, p AS score, {r6('CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END')} AS precision,
       {r6('CASE WHEN tot_pos = 0 THEN 0 ELSE tp / tot_pos END')} AS recall FROM cum
UNION ALL
SELECT DISTINCT model, NULL::DOUBLE, 1.0, 0.0 FROM pred"""
    ),
)
def q_pr_points(spark, sf_dir):
    return rounded(metrics.pr_points(tables.predictions(spark, sf_dir)))


_SWEEP_SQL = """
, th AS (SELECT j, CASE WHEN j = 98 THEN CAST(0.99 AS DOUBLE)
                   ELSE CAST(j AS DOUBLE) * ((CAST(0.99 AS DOUBLE) - CAST(0.01 AS DOUBLE)) / CAST(98 AS DOUBLE)) + CAST(0.01 AS DOUBLE) END AS t
         FROM range(0, 99) r(j)),
models AS (SELECT DISTINCT model FROM pred),
sw AS (
  SELECT m.model, th.j, th.t,
         (SELECT count(*) FROM pred WHERE pred.model = m.model AND label = 1 AND p >= th.t) AS tp,
         (SELECT count(*) FROM pred WHERE pred.model = m.model AND label <> 1 AND p >= th.t) AS fp,
         (SELECT count(*) FROM pred WHERE pred.model = m.model AND label = 1 AND p < th.t) AS fn
  FROM models m, th
),
sm AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS prec,
            CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS rec,
            CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
  FROM sw
)"""


@register(
    "threshold_sweep",
    O.with_pred(
        _SWEEP_SQL
        + f"""
SELECT model, CAST(j AS INTEGER) AS j, {r6('t')} AS threshold, tp, fp, fn, {r6('prec')} AS precision, {r6('rec')} AS recall, {r6('f1')} AS f1 FROM sm"""
    ).replace("\n, th AS", ",\nth AS"),
)
def q_threshold_sweep(spark, sf_dir):
    return rounded(metrics.threshold_sweep(tables.predictions(spark, sf_dir)))


@register(
    "best_f1_threshold",
    O.with_pred(
        _SWEEP_SQL
        + f"""
SELECT model, {r6('first(t ORDER BY f1 DESC, j)')} AS best_threshold, {r6('max(f1)')} AS best_f1 FROM sm GROUP BY model"""
    ).replace("\n, th AS", ",\nth AS"),
)
def q_best_f1(spark, sf_dir):
    return rounded(metrics.best_f1_threshold(metrics.threshold_sweep(tables.predictions(spark, sf_dir))))


def _metrics_with_position(spark, sf_dir):
    m = metrics.evaluate(tables.predictions(spark, sf_dir), 0.5)
    return m.withColumn("position", F.when(F.col("model_name") == "m1", 0).otherwise(1))


_M_SQL = _cum(
    """,
auc AS (
  SELECT model, sum(npos * ((tot_neg - fp) + nneg / 2.0)) / (any_value(tot_pos) * any_value(tot_neg)) AS roc_auc,
         sum(CASE WHEN tot_pos = 0 THEN 0 ELSE npos / tot_pos END * CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END) AS pr_auc
  FROM cum GROUP BY model
),
cm AS (
  SELECT model, count(*) FILTER (WHERE label <> 1 AND p < 0.5) AS tn, count(*) FILTER (WHERE label <> 1 AND p >= 0.5) AS fp,
         count(*) FILTER (WHERE label = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND p >= 0.5) AS tp
  FROM pred GROUP BY model
),
met AS (
  SELECT cm.model AS model_name,
         round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 4) AS precision,
         round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 4) AS recall,
         round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1_score,
         round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc,
         CASE WHEN cm.model = 'm1' THEN 0 ELSE 1 END AS position
  FROM cm LEFT JOIN auc USING (model)
)"""
)


@register(
    "metrics_long",
    _M_SQL
    + """
SELECT model_name, metric, value FROM met UNPIVOT (value FOR metric IN (precision, recall, f1_score, roc_auc, pr_auc))""",
)
def q_metrics_long(spark, sf_dir):
    return metrics.metrics_long(_metrics_with_position(spark, sf_dir))


@register(
    "metrics_highlight",
    _M_SQL
    + """
SELECT model_name, precision = max(precision) OVER () AS is_max_precision, recall = max(recall) OVER () AS is_max_recall,
       f1_score = max(f1_score) OVER () AS is_max_f1_score, roc_auc = max(roc_auc) OVER () AS is_max_roc_auc,
       pr_auc = max(pr_auc) OVER () AS is_max_pr_auc
FROM met""",
)
def q_metrics_highlight(spark, sf_dir):
    m = metrics.highlight_max(_metrics_with_position(spark, sf_dir))
    return m.select("model_name", *[f"is_max_{c}" for c in metrics.METRIC_COLUMNS])


@register(
    "best_model_by_recall",
    _M_SQL
    + """
SELECT model_name, recall, precision, f1_score, roc_auc, pr_auc FROM met ORDER BY recall DESC, position LIMIT 1""",
)
def q_best_model(spark, sf_dir):
    m = metrics.best_by_recall(_metrics_with_position(spark, sf_dir))
    return m.select("model_name", "recall", "precision", "f1_score", "roc_auc", "pr_auc")


# ---------------------------------------------------------------------------
# Risk scoring and alerts
# ---------------------------------------------------------------------------

from txrisk.operators import alerts  # noqa: E402


def scored_rows(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Transactions scored with the fixture probability, without ids."""
    tx = tables.transactions(spark, sf_dir).select("id", "Time", "Amount")
    p = (tables.fixture_probability(F.col("Amount")) / 1000.0).alias("fraud_probability")
    scored = alerts.score(tx.select("id", "Time", p), threshold=threshold)
    return scored.withColumns({"alert_action": R.risk_action(F.col("risk_level")), "alert_color": R.alert_struct(F.col("fraud_score"))["color"]})


def scored_transactions(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """The same with ids ``TX_%06d`` in (Time, id) order."""
    return alerts.assign_tx_ids(scored_rows(spark, sf_dir, threshold), ["Time", "id"])


def _scored_sql(threshold: str = "CAST(0.5 AS DOUBLE)") -> str:
    return f"""
, sc AS (SELECT id, Time,
               CAST(least(greatest(CAST(floor((2 * CAST(round(Amount * 100) AS BIGINT) + 5) / 10) AS BIGINT), 0), 1000) AS DOUBLE) / 1000.0 AS p
        FROM tx),
s2 AS (SELECT id, Time, p, round(least(greatest(p * 100.0, 0.0), 100.0), 1) AS fraud_score FROM sc),
s3 AS (SELECT *, CASE WHEN fraud_score < 30 THEN 'SAFE' WHEN fraud_score < 70 THEN 'SUSPICIOUS' ELSE 'FRAUD' END AS risk_level FROM s2),
scored AS (
  SELECT printf('TX_%06d', row_number() OVER (ORDER BY Time, id)) AS tx_id, id, Time,
         p AS fraud_probability, fraud_score, risk_level,
         CASE WHEN p >= greatest(0.01, least(0.99, {threshold})) THEN 'BLOCK'
              WHEN risk_level = 'SAFE' THEN 'APPROVE' WHEN risk_level = 'SUSPICIOUS' THEN 'REVIEW' ELSE 'BLOCK' END AS decision,
         CAST(greatest(0.01, least(0.99, {threshold})) AS DOUBLE) AS threshold_used,
         CASE risk_level WHEN 'SAFE' THEN 'APPROVE' WHEN 'SUSPICIOUS' THEN 'REVIEW' ELSE 'BLOCK' END AS alert_action,
         CASE risk_level WHEN 'SAFE' THEN '#22c55e' WHEN 'SUSPICIOUS' THEN '#f59e0b' ELSE '#ef4444' END AS alert_color
  FROM s3
)"""


_SCORED_COLS = "tx_id, id, Time, fraud_probability, fraud_score, risk_level, decision, threshold_used, alert_action, alert_color"


@register("risk_scoring", O.with_tx(_scored_sql() + f"\nSELECT tx_id, id, {r6('Time')} AS Time, fraud_probability, fraud_score, risk_level, decision, threshold_used, alert_action, alert_color FROM scored"))
def q_risk_scoring(spark, sf_dir):
    return rounded(scored_transactions(spark, sf_dir).select(*_SCORED_COLS.split(", ")))


@register(
    "risk_scoring_clamped_threshold",
    O.with_tx(_scored_sql("CAST(1.5 AS DOUBLE)") + "\nSELECT tx_id, fraud_probability, fraud_score, risk_level, decision, threshold_used FROM scored"),
)
def q_risk_scoring_clamped(spark, sf_dir):
    # a threshold above the allowed range is clamped to 0.99
    s = scored_transactions(spark, sf_dir, threshold=1.5)
    return rounded(s.select("tx_id", "fraud_probability", "fraud_score", "risk_level", "decision", "threshold_used"))


def _metadata_sql(index: int) -> str:
    cases = " ".join("WHEN '{}' THEN '{}'".format(level, str(v[index]).replace("'", "''")) for level, v in ALERT_METADATA.items())
    return f"CASE risk_level {cases} END"


@register(
    "risk_scoring_five_decimals",
    O.with_tx(
        f"""
, k AS (SELECT id, id * 7919 % 100001 AS k FROM tx),
p AS (SELECT id, CASE WHEN k % 100 = 50 THEN k + 1 ELSE k END AS k FROM k),
s AS (SELECT id, k / 100000.0::DOUBLE AS p, ((k + 50) // 100) / 10.0::DOUBLE AS fraud_score FROM p),
r AS (SELECT *, CASE WHEN fraud_score < 30 THEN 'SAFE' WHEN fraud_score < 70 THEN 'SUSPICIOUS' ELSE 'FRAUD' END AS risk_level FROM s)
SELECT id, fraud_score, risk_level, CASE WHEN p >= 0.65::DOUBLE THEN 'BLOCK' ELSE {_metadata_sql(3)} END AS decision,
       {_metadata_sql(0)} AS color, {_metadata_sql(1)} AS icon, {_metadata_sql(2)} AS description, {_metadata_sql(3)} AS action
FROM r"""
    ),
)
def q_risk_five_decimals(spark, sf_dir):
    # probabilities that the one-decimal score rounds (no exact halves, which are not the same in doubles), all alert fields
    k = F.col("id") * 7919 % 100001
    p = F.when(k % 100 == 50, k + 1).otherwise(k) / F.lit(100000.0)
    s = alerts.score(tables.transactions(spark, sf_dir).select("id", p.alias("fraud_probability")), threshold=0.65, with_alert=True)
    return s.select("id", "fraud_score", "risk_level", "decision", "alert.color", "alert.icon", "alert.description", "alert.action")


@register(
    "running_stats",
    O.with_tx(
        _scored_sql()
        + f"""
SELECT count(*) AS total_processed, count(*) FILTER (WHERE risk_level = 'FRAUD') AS fraud_detected,
       {r6('avg(fraud_score)')} AS avg_score,
       count(*) FILTER (WHERE risk_level = 'SAFE') AS n_safe, count(*) FILTER (WHERE risk_level = 'SUSPICIOUS') AS n_suspicious,
       count(*) FILTER (WHERE risk_level = 'FRAUD') AS n_fraud,
       round(count(*) FILTER (WHERE risk_level = 'FRAUD') / greatest(count(*), 1) * 100.0, 2) AS fraud_rate_pct,
       CAST(0.5 AS DOUBLE) AS current_threshold
FROM scored"""
    ),
)
def q_running_stats(spark, sf_dir):
    return rounded(alerts.running_stats(scored_rows(spark, sf_dir)).drop("alert_distribution"))


@register(
    "alert_counts",
    O.with_tx(
        _scored_sql()
        + f"""
SELECT count(*) AS total_alerts, count(*) FILTER (WHERE risk_level = 'SAFE') AS n_safe,
       count(*) FILTER (WHERE risk_level = 'SUSPICIOUS') AS n_suspicious, count(*) FILTER (WHERE risk_level = 'FRAUD') AS n_fraud,
       {r6("CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE risk_level = 'FRAUD') / count(*) * 100.0 END")} AS detection_rate_pct
FROM scored"""
    ),
)
def q_alert_counts(spark, sf_dir):
    return rounded(alerts.risk_counts(scored_rows(spark, sf_dir)))


@register(
    "alert_board",
    O.with_tx(
        _scored_sql()
        + """
SELECT tx_id, fraud_score, fraud_probability, risk_level, decision FROM scored
WHERE risk_level IN ('SUSPICIOUS', 'FRAUD') ORDER BY fraud_score DESC, Time, id LIMIT 100"""
    ),
)
def q_alert_board(spark, sf_dir):
    return rounded(alerts.table_board(scored_rows(spark, sf_dir)))


@register(
    "alert_board_all_levels",
    O.with_tx(
        _scored_sql()
        + """
SELECT tx_id, fraud_score, fraud_probability, risk_level, decision FROM scored ORDER BY fraud_score DESC, Time, id LIMIT 100"""
    ),
)
def q_alert_board_all(spark, sf_dir):
    # an empty risk selection means every level
    return rounded(alerts.table_board(scored_rows(spark, sf_dir), levels=[]))


@register(
    "recent_predictions",
    O.with_tx(
        _scored_sql()
        + """
SELECT tx_id, fraud_score, risk_level, decision FROM scored ORDER BY Time DESC, id DESC LIMIT 20"""
    ),
)
def q_recent(spark, sf_dir):
    return alerts.table_recent(scored_rows(spark, sf_dir), 20).select("tx_id", "fraud_score", "risk_level", "decision")


@register(
    "stream_head",
    O.with_tx(
        _scored_sql()
        + """
SELECT tx_id, fraud_probability, fraud_score, risk_level, decision FROM scored ORDER BY Time, id LIMIT 500"""
    ),
)
def q_stream_head(spark, sf_dir):
    # max_transactions: the first 500 transactions of the stream order
    return alerts.table_head(scored_rows(spark, sf_dir), 500).select("tx_id", "fraud_probability", "fraud_score", "risk_level", "decision")


# ---------------------------------------------------------------------------
# Sampling, rebalancing, neighbours (SP1-SP7, A13, J1, W4, U1-U3)
# ---------------------------------------------------------------------------

from txrisk.operators import knn as K  # noqa: E402
from txrisk.operators import sampling as S  # noqa: E402
from txrisk.schema import V_COLUMNS  # noqa: E402

_SPLIT_SQL = """
, cc AS (SELECT Class, count(*) AS n_c FROM tx GROUP BY Class),
tot AS (SELECT sum(n_c) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n_c)) AS BIGINT) AS n_test FROM cc),
alloc AS (SELECT Class, n_c, CAST(n - n_test AS DOUBLE) * n_c / n AS cont,
                 floor(CAST(n - n_test AS DOUBLE) * n_c / n) AS fl, n - n_test AS n_train_total FROM cc, tot),
ranked AS (SELECT *, row_number() OVER (ORDER BY cont - fl DESC, Class) AS rr, n_train_total - sum(fl) OVER () AS left_ FROM alloc),
tr AS (SELECT Class, n_c, CAST(fl + CASE WHEN rr <= left_ THEN 1 ELSE 0 END AS BIGINT) AS n_train FROM ranked)"""


@register(
    "split_counts",
    O.with_tx(
        _SPLIT_SQL
        + """
SELECT CAST(Class AS INTEGER) AS Class, 'train' AS split, n_train AS count FROM tr
UNION ALL SELECT CAST(Class AS INTEGER), 'test', n_c - n_train FROM tr"""
    ),
)
def q_split_counts(spark, sf_dir):
    s = S.with_split(tables.transactions(spark, sf_dir))
    return s.groupBy(F.col("Class").cast("int").alias("Class"), "split").agg(F.count(F.lit(1)).alias("count"))


@register(
    "train_test_split",
    O.with_tx(
        _SPLIT_SQL
        + f""",
d AS (SELECT id, tx.Class, n_c - n_train AS n_test, row_number() OVER (PARTITION BY tx.Class ORDER BY {sql_draw(42, "id")}, id) AS r
      FROM tx JOIN tr ON tx.Class = tr.Class)
SELECT id, Class, CASE WHEN r <= n_test THEN 'test' ELSE 'train' END AS split FROM d"""
    ),
)
def q_train_test_split(spark, sf_dir):
    return S.with_split(tables.transactions(spark, sf_dir)).select("id", "Class", "split")


@register(
    "undersample_counts",
    O.with_tx(
        """
, cc AS (SELECT count(*) FILTER (WHERE Class = 1) AS n_min, count(*) FILTER (WHERE Class <> 1) AS n_maj FROM tx)
SELECT 1 AS Class, n_min AS count FROM cc
UNION ALL SELECT 0, least(CAST(floor(n_min * CAST(2.5 AS DOUBLE)) AS BIGINT), n_maj) FROM cc"""
    ),
)
def q_undersample_counts(spark, sf_dir):
    u = S.random_undersample(tables.transactions(spark, sf_dir), ratio=2.5)
    return u.groupBy(F.col("Class").cast("int").alias("Class")).agg(F.count(F.lit(1)).alias("count"))


def _undersample_sql(ratio: float) -> str:
    return O.with_tx(
        f"""
, cc AS (SELECT least(CAST(floor(count(*) FILTER (WHERE Class = 1) * CAST({ratio} AS DOUBLE)) AS BIGINT), count(*) FILTER (WHERE Class <> 1)) AS keep FROM tx),
d AS (SELECT id, Class, row_number() OVER (ORDER BY {sql_draw(42, "id")}, id) AS r FROM tx WHERE Class <> 1)
SELECT id, Class FROM tx WHERE Class = 1 UNION ALL SELECT id, Class FROM d, cc WHERE r <= keep"""
    )


@register("undersample_rows", _undersample_sql(10.0))
def q_undersample_rows(spark, sf_dir):
    return S.random_undersample(tables.transactions(spark, sf_dir), ratio=10.0).select("id", "Class")


@register("undersample_rows_ratio_2_5", _undersample_sql(2.5))
def q_undersample_rows_small(spark, sf_dir):
    # fewer than all majority rows: membership depends on the draws
    return S.random_undersample(tables.transactions(spark, sf_dir), ratio=2.5).select("id", "Class")


@register(
    "class_weights",
    O.with_tx(
        f"""
, cc AS (SELECT Class, count(*) AS count FROM tx GROUP BY Class)
SELECT CAST(Class AS INTEGER) AS Class, count, {r6('(SELECT sum(count) FROM cc) / ((SELECT count(*) FROM cc) * count)')} AS weight FROM cc"""
    ),
)
def q_class_weights(spark, sf_dir):
    w = S.class_weights(tables.transactions(spark, sf_dir))
    return rounded(w.select(F.col("Class").cast("int").alias("Class"), "count", "weight"))


@register(
    "fold_rows",
    O.with_tx(
        f"""
, d AS (SELECT id, Class, row_number() OVER (PARTITION BY Class ORDER BY {sql_draw(42, "id")}, id) AS r, count(*) OVER (PARTITION BY Class) AS n FROM tx)
SELECT id, CAST(CASE WHEN r <= n // 3 + least(1, n % 3) THEN 0 WHEN r <= 2 * (n // 3) + least(2, n % 3) THEN 1 ELSE 2 END AS INTEGER) AS fold FROM d"""
    ),
)
def q_fold_rows(spark, sf_dir):
    return S.stratified_folds(tables.transactions(spark, sf_dir), 3).select("id", "fold")


@register(
    "capped_majority_rows",
    O.with_tx(
        f"""
, d AS (SELECT id, Class, row_number() OVER (ORDER BY {sql_draw(42, "id")}, id) AS r FROM tx WHERE Class <> 1)
SELECT id, Class FROM tx WHERE Class = 1 UNION ALL SELECT id, Class FROM d WHERE r <= 450"""
    ),
)
def q_capped_majority(spark, sf_dir):
    # the boosting cap, above 500 rows: every fraud row and 450 others
    return S.cap_majority(tables.transactions(spark, sf_dir), max_rows=500, keep_majority=450).select("id", "Class")


@register(
    "shuffled_order",
    O.with_tx(f"""\nSELECT id, row_number() OVER (ORDER BY {sql_draw(42, "id")}, id) - 1 AS place FROM tx"""),
)
def q_shuffled(spark, sf_dir):
    # the rows' places in the hashed order
    tx = tables.transactions(spark, sf_dir).select("id")
    return ordering.with_positions(tx.withColumn("_u", draw(42, "id")), ["_u", "id"], pos_col="place").select("id", "place")


@register(
    "fold_counts",
    O.with_tx(
        """
, cc AS (SELECT Class, count(*) AS n_c FROM tx GROUP BY Class)
SELECT CAST(Class AS INTEGER) AS Class, CAST(f AS INTEGER) AS fold, CAST(floor((n_c - f - 1) / 3) + 1 AS BIGINT) AS count
FROM cc, range(0, 3) r(f) WHERE n_c > f"""
    ),
)
def q_fold_counts(spark, sf_dir):
    f = S.stratified_folds(tables.transactions(spark, sf_dir), 3)
    return f.groupBy(F.col("Class").cast("int").alias("Class"), "fold").agg(F.count(F.lit(1)).alias("count"))


def _knn_sql(k: int) -> str:
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in V_COLUMNS)
    return O.with_tx(
        f"""
, m AS (SELECT * FROM tx WHERE Class = 1),
pairs AS (SELECT a.id, b.id AS nid, sqrt({d2}) AS dist FROM m a JOIN m b ON a.id <> b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rank FROM pairs)
SELECT id, CAST(rank AS INTEGER) AS rank, nid, {r6('dist')} AS dist FROM ranked WHERE rank <= {k}"""
    )


@register("knn_minority", _knn_sql(5))
def q_knn_minority(spark, sf_dir):
    m = tables.transactions(spark, sf_dir).filter("Class = 1")
    return rounded(K.knn(m, V_COLUMNS, 5))


@register("knn_minority_k25", _knn_sql(25))
def q_knn_minority_k25(spark, sf_dir):
    # more neighbours than copies: reaches the distinct-vector search
    m = tables.transactions(spark, sf_dir).filter("Class = 1")
    return rounded(K.knn(m, V_COLUMNS, 25))


@register(
    "smote_allocation",
    O.with_tx(
        """
, m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM tx WHERE Class = 1),
cc AS (SELECT count(*) FILTER (WHERE Class = 1) AS n_min, count(*) FILTER (WHERE Class <> 1) AS n_maj FROM tx),
g AS (SELECT n_maj - n_min AS n_gen, (n_maj - n_min) // n_min + 1 AS n_per FROM cc)
SELECT id AS base_id, CAST(greatest(0, least(n_per, n_gen - pos * n_per)) AS BIGINT) AS n_synthetic FROM m, g"""
    ),
)
def q_smote_allocation(spark, sf_dir):
    tx = tables.transactions(spark, sf_dir)
    out = S.smote(tx, V_COLUMNS)
    made = out.filter("is_synthetic").groupBy("base_id").agg(F.count(F.lit(1)).alias("n_synthetic"))
    bases = tx.filter("Class = 1").select(F.col("id").alias("base_id"))
    return bases.join(made, "base_id", "left").select("base_id", F.coalesce("n_synthetic", F.lit(0)).cast("bigint").alias("n_synthetic"))


_SMOTE_OUT = ", ".join(f"{r6(c)} AS {c}" for c in V_COLUMNS)


@register(
    "smote_rows",
    _knn_sql(5).split("SELECT id, CAST(rank")[0]
    + f""",
mm AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM m),
cc AS (SELECT count(*) FILTER (WHERE Class = 1) AS n_min, count(*) FILTER (WHERE Class <> 1) AS n_maj FROM tx),
g AS (SELECT n_maj - n_min AS n_gen, (n_maj - n_min) // n_min + 1 AS n_per, least(5, n_min - 1) AS k FROM cc),
slots AS (SELECT mm.*, n_per, k, unnest(range(greatest(0, least(n_per, n_gen - pos * n_per)))) AS s FROM mm, g),
d AS (SELECT *, floor({sql_uniform(42, "id", "s", salt=1)} * k) + 1 AS pick, {sql_uniform(42, "id", "s", salt=2)} AS alpha FROM slots),
made AS (SELECT -(d.pos * d.n_per + d.s) - 1 AS id, {", ".join(f"d.{c} + d.alpha * (b.{c} - d.{c}) AS {c}" for c in V_COLUMNS)}, 1 AS Class, true AS is_synthetic, d.id AS base_id
  FROM d JOIN ranked r ON r.id = d.id AND r.rank = d.pick JOIN m b ON b.id = r.nid),
both_ AS (SELECT id, {", ".join(V_COLUMNS)}, Class, false AS is_synthetic, NULL::BIGINT AS base_id FROM tx UNION ALL SELECT * FROM made)
SELECT id, {_SMOTE_OUT}, Class, is_synthetic, base_id FROM both_""",
)
def q_smote_rows(spark, sf_dir):
    return rounded(S.smote(tables.transactions(spark, sf_dir), V_COLUMNS))


# ---------------------------------------------------------------------------
# Feature lookup, importance ranking, explanation aggregates
# ---------------------------------------------------------------------------

from txrisk.operators import explain as X  # noqa: E402
from txrisk.schema import FEATURE_COLUMNS, display_name  # noqa: E402


def _names_sql() -> str:
    vals = ", ".join(
        "('{}', '{}', {})".format(f, display_name(f).replace("'", "''"), i) for i, f in enumerate(FEATURE_COLUMNS)
    )
    return f"names AS (SELECT * FROM (VALUES {vals}) t(feature, display_name, position))"


_LONG_SQL = (
    _FEAT_CTES
    + ",\nlong AS (SELECT id, Class, feature, value FROM (SELECT id, Class, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURE_COLUMNS)
    + " FROM g) UNPIVOT (value FOR feature IN ("
    + ", ".join(FEATURE_COLUMNS)
    + "))),\n"
    + _names_sql()
)


def _engineered_moments(spark, sf_dir, *groups) -> DataFrame:
    """Moments of all features per label (and group), from one pass over the wide rows."""
    feats, _ = features.engineer_features(tables.transactions(spark, sf_dir))
    return moments.label_moments(feats, FEATURE_COLUMNS, "Class", groups)


def _feature_lookup(spark) -> DataFrame:
    return spark.createDataFrame(
        [(f, display_name(f), i) for i, f in enumerate(FEATURE_COLUMNS)], "feature string, display_name string, position int"
    )


@register(
    "feature_profile",
    O.with_tx(
        _LONG_SQL
        + f"""
SELECT feature, display_name,
       CASE WHEN feature LIKE 'V%' THEN 'PCA' WHEN feature LIKE '%Amount%' OR feature LIKE '%amount%' THEN 'Amount' ELSE 'Engineered' END AS feature_group,
       {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS std
FROM long JOIN names USING (feature) GROUP BY feature, display_name"""
    ),
)
def q_feature_profile(spark, sf_dir):
    prof = moments.moments(_engineered_moments(spark, sf_dir))
    # 38-row lookup: broadcast
    out = prof.join(F.broadcast(_feature_lookup(spark)), "feature").select(
        "feature", "display_name", R.feature_group(F.col("feature")).alias("feature_group"), "mean", "std"
    )
    return rounded(out)


_CORR_SQL = (
    "CASE WHEN stddev_pop(value) <= 1e-10 * greatest(1.0, abs(avg(value))) "
    "OR stddev_pop(Class) <= 1e-10 * greatest(1.0, abs(avg(Class))) THEN 0.0 "
    "ELSE coalesce(covar_pop(value, Class) / (stddev_pop(value) * stddev_pop(Class)), 0.0) END"
)


@register(
    "importance_ranking",
    O.with_tx(
        _LONG_SQL
        + f""",
raw AS (SELECT feature, abs({_CORR_SQL}) AS raw FROM long GROUP BY feature),
norm AS (SELECT raw.feature, raw.raw / sum(raw.raw) OVER () AS importance, position FROM raw JOIN names USING (feature))
SELECT feature, {r6('importance')} AS importance, round(importance * 100.0, 2) AS importance_pct,
       CAST(row_number() OVER (ORDER BY importance DESC, position) AS INTEGER) AS rank
FROM norm"""
    ),
)
def q_importance_ranking(spark, sf_dir):
    # importance = |correlation with the label| of each engineered feature, then the published normalise/rank rule
    raw = moments.label_correlation(_engineered_moments(spark, sf_dir)).select("feature", F.abs("correlation").alias("raw"))
    raw = raw.join(F.broadcast(_feature_lookup(spark).select("feature", "position")), "feature")
    return rounded(X.rank_importance(raw), importance_pct=2)


@register(
    "top_features",
    O.with_tx(
        _LONG_SQL
        + f""",
raw AS (SELECT feature, abs({_CORR_SQL}) AS raw FROM long GROUP BY feature),
norm AS (SELECT raw.feature, raw.raw / sum(raw.raw) OVER () AS importance, position, display_name FROM raw JOIN names USING (feature)),
rk AS (SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, position) AS INTEGER) AS rank FROM norm)
SELECT feature, rank, display_name,
       CASE WHEN feature LIKE 'V%' THEN 'PCA' WHEN feature LIKE '%Amount%' OR feature LIKE '%amount%' THEN 'Amount' ELSE 'Engineered' END AS "group"
FROM rk WHERE rank <= 20"""
    ),
)
def q_top_features(spark, sf_dir):
    raw = moments.label_correlation(_engineered_moments(spark, sf_dir)).select("feature", F.abs("correlation").alias("raw"))
    raw = raw.join(F.broadcast(_feature_lookup(spark).select("feature", "position")), "feature")
    return X.top_features(X.rank_importance(raw), 20).select("feature", "rank", "display_name", "group")


@register(
    "feature_label_correlation",
    O.with_tx(
        _LONG_SQL
        + f"""
SELECT CAST(CAST(floor(fmod(Time / 3600.0, 24.0)) AS INTEGER) // 6 AS INTEGER) AS day_part, feature,
       {r6(_CORR_SQL)} AS contribution
FROM long JOIN (SELECT id, Time FROM tx) USING (id) GROUP BY ALL"""
    ),
)
def q_feature_label_correlation(spark, sf_dir):
    # zero-safe correlation aggregate (explanation contributions), per quarter of the day and feature
    part = (F.floor(F.pmod(F.col("Time") / 3600.0, F.lit(24.0))).cast("int") / 6).cast("int").alias("day_part")
    out = moments.label_correlation(_engineered_moments(spark, sf_dir, part), ["day_part"])
    return rounded(out.withColumnRenamed("correlation", "contribution"))


@register(
    "noise_scale",
    O.with_tx(
        f"""
SELECT id, {r6("list_stddev_pop([" + ", ".join(V_COLUMNS) + "]) * 0.1 + 1e-8", 8)} AS noise_scale FROM tx"""
    ),
)
def q_noise_scale(spark, sf_dir):
    tx = tables.transactions(spark, sf_dir)
    return rounded(tx.select("id", X.noise_scale(K.vector(V_COLUMNS)).alias("noise_scale")), 8)


@register(
    "csv_ingest_roundtrip",
    O.with_tx("\nSELECT id, Class, " + ", ".join(f"{c}" for c in ["Time", "Amount"] + V_COLUMNS) + " FROM tx WHERE Class IN (0, 1)"),
)
def q_csv_ingest(spark, sf_dir):
    """Transactions written as CSV (columns shuffled, one extra) and read back by header name."""
    from txrisk.session import checkpoint_dir
    from txrisk.sources import ingest

    import uuid

    tx = tables.transactions(spark, sf_dir)
    cols = list(reversed(tx.columns))
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-ingest-{uuid.uuid4().hex}"
    tx.select(*cols, F.lit("x").alias("note")).write.option("header", True).csv(path)
    back = ingest.read_transactions_csv(spark, path)
    return cleaning.clean(back).select("id", "Class", "Time", "Amount", *V_COLUMNS)


@register(
    "csv_first_rows",
    O.with_tx("\nSELECT id, Class, Time, Amount FROM tx ORDER BY id LIMIT 777"),
)
def q_csv_first_rows(spark, sf_dir):
    """The first 777 lines of transactions written in order of id to four CSV files."""
    from txrisk.sources import ingest

    path = _scratch(spark, "csv-first")
    tables.transactions(spark, sf_dir).repartitionByRange(4, "id").sortWithinPartitions("id").write.option("header", True).csv(path)
    return ingest.read_transactions_csv(spark, path, limit=777).select("id", "Class", "Time", "Amount")


# ---------------------------------------------------------------------------
# Trained models: scoring, evaluation, importance, explanations, stream (rows-only: M1-M10, ST1-ST6)
# ---------------------------------------------------------------------------

from txrisk.operators import alerts as A  # noqa: E402
from txrisk.plans import models as M  # noqa: E402
from txrisk.plans.scoring import score_records, score_table  # noqa: E402

_TRAINED: dict = {}


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    from txrisk.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def trained_models(spark: SparkSession, sf_dir: str):
    """Fitted statistics, three small models, the features of all rows and those of the test rows (cached per session and folder)."""
    key = (id(spark.sparkContext), sf_dir)
    if key not in _TRAINED:
        tx = tables.transactions(spark, sf_dir)
        split = S.with_split(tx)
        stats_ = features.fit_feature_stats(split.filter(F.col("split") == "train"))
        feats, _ = features.engineer_features(split, stats_)
        path = _scratch(spark, "features")
        feats.write.parquet(path)  # cut the lineage before model loops
        feats = spark.read.parquet(path)
        train = feats.filter(F.col("split") == "train").drop("split")
        test = feats.filter(F.col("split") == "test").drop("split")
        train_w = S.with_class_weights(train)
        total_w = train_w.agg(F.sum("weight")).first()[0]
        with ordering.scans_by_rows(spark, stats_.n_rows):  # MLlib keeps its own copies of the rows; no other is cached
            models = {
                "Logistic Regression": M.fit(M.logistic_regression("weight", max_iter=100, total_weight=total_w), train_w),
                "Random Forest": M.fit(M.random_forest("weight", num_trees=30, max_depth=8), train_w),
                "Gradient Boosting": M.fit(M.gradient_boosting(max_iter=20, max_depth=4), train),
            }
        _TRAINED[key] = (stats_, models, feats.drop("split"), test)
    return _TRAINED[key]


@register("model_scores")
def q_model_scores(spark, sf_dir):
    stats_, models, rows, _ = trained_models(spark, sf_dir)
    scored = score_table(models["Gradient Boosting"], rows.select("id", "Time", "Amount", *V_COLUMNS), stats_, keep=("id", "Time"))
    return A.assign_tx_ids(scored, ["Time", "id"])


@register("model_evaluation")
def q_model_evaluation(spark, sf_dir):
    _, models, _, test = trained_models(spark, sf_dir)
    return metrics.metrics_record(metrics.evaluate(M.predictions_long(models, test), 0.5))


@register("model_feature_importance")
def q_model_importance(spark, sf_dir):
    _, models, _, _ = trained_models(spark, sf_dir)
    return X.importance_table(spark, FEATURE_COLUMNS, M.importance_vector(models["Gradient Boosting"]))


@register("local_explanations")
def q_local_explanations(spark, sf_dir):
    # every flagged (SUSPICIOUS or FRAUD) row, 500 perturbations each
    _, models, rows, _ = trained_models(spark, sf_dir)
    gb = models["Gradient Boosting"]
    scored = A.score(M.probability_of_fraud(gb.transform(rows)), threshold=0.5)
    flagged = scored.filter(F.col("risk_level").isin("SUSPICIOUS", "FRAUD")).select("id", *FEATURE_COLUMNS)
    return X.explain_local(gb, flagged, id_col="id", n_perturbations=500)


@register("record_scoring")
def q_record_scoring(spark, sf_dir):
    stats_, models, rows, _ = trained_models(spark, sf_dir)
    recs = rows.select(F.format_string("REC_%d", F.col("id")).alias("tx_id"), "Time", "Amount", *V_COLUMNS)
    return score_records(models["Gradient Boosting"], recs, stats_)


def _in_order(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Give the files of some folders modification times in the order of the folders, as if they had arrived one after another."""
    from txrisk.sources.artifacts import _hadoop

    for i, name in enumerate(names):
        fs, path = _hadoop(spark, f"{folder}/{name}")
        for st in fs.listStatus(path):
            fs.setTimes(st.getPath(), 1_600_000_000_000 + 60_000 * i, -1)


def _daily_files(spark: SparkSession, rows: DataFrame, folder: str) -> int:
    """``rows`` as one file a day, the days in order; returns their number."""
    from txrisk.sources.artifacts import listed

    rows = rows.withColumn("day", F.format_string("%06d", F.floor(F.col("Time") / 86400).cast("long")))
    n = rows.count()
    rows = ordering.spread(rows, n, "day") if ordering.task_count(n) > 1 else rows.repartition("day")
    rows.write.mode("append").partitionBy("day").parquet(folder)
    days = listed(spark, folder, "day=")
    _in_order(spark, folder, [f"day={d}" for d in days])
    return len(days)


@register("stream_prediction_log")
def q_stream_log(spark, sf_dir):
    """All transactions streamed in order of their days, in six micro-batches, through the scorer; the dated log read back."""
    from txrisk.sources import artifacts
    from txrisk.streaming.scorer import StreamScorer, read_stream

    stats_, models, _, _ = trained_models(spark, sf_dir)
    tx = tables.transactions(spark, sf_dir)
    base = _scratch(spark, "stream")
    days = _daily_files(spark, tx, f"{base}/in")
    scorer = StreamScorer(spark, models["Gradient Boosting"], stats_, f"{base}/log", f"{base}/state")
    q = scorer.start(read_stream(spark, f"{base}/in", tx.schema, max_files=-(-days // 6)), f"{base}/ckpt")
    q.awaitTermination()
    return artifacts.read_log(spark, f"{base}/log").drop("log_date", "timestamp")


@register(
    "stream_running_stats",
    O.with_tx(
        _scored_sql()
        + f""",
last AS (SELECT * FROM scored ORDER BY Time DESC, id DESC LIMIT 20)
SELECT count(*) AS total_processed, count(*) FILTER (WHERE risk_level = 'FRAUD') AS fraud_detected,
       {r6('avg(fraud_score)')} AS avg_score,
       count(*) FILTER (WHERE risk_level = 'SAFE') AS n_safe, count(*) FILTER (WHERE risk_level = 'SUSPICIOUS') AS n_suspicious,
       count(*) FILTER (WHERE risk_level = 'FRAUD') AS n_fraud,
       round(count(*) FILTER (WHERE risk_level = 'FRAUD') / greatest(count(*), 1) * 100.0, 2) AS fraud_rate_pct,
       CAST(0.5 AS DOUBLE) AS current_threshold,
       (SELECT string_agg(tx_id || ' ' || risk_level || ' ' || decision, ',' ORDER BY Time, id) FROM last) AS recent_alerts
FROM scored"""
    ),
)
def q_stream_running_stats(spark, sf_dir):
    """Scored transactions streamed in six micro-batches, the query stopped and started again half way; totals and the last 20."""
    from txrisk.streaming import running
    from txrisk.streaming.scorer import read_stream

    base = _scratch(spark, "running")
    rows = scored_transactions(spark, sf_dir)
    half = F.col("Time") < float(rows.agg(F.max("Time")).first()[0] or 0.0) // 172800 * 86400
    own = running.stream_session(spark)
    for part in (rows.filter(half), rows.filter(~half)):  # the query ends with the first half; another goes on from its state
        days = _daily_files(spark, part, f"{base}/in")
        stream = read_stream(own, f"{base}/in", rows.schema, max_files=max(1, -(-days // 6)))
        running.start(stream, f"{base}/out", f"{base}/ckpt").awaitTermination()
    out = running.statistics(spark, f"{base}/out").drop("alert_distribution")
    last = F.array_join(F.transform("recent_alerts", lambda r: F.concat_ws(" ", r["tx_id"], r["risk_level"], r["decision"])), ",")
    return rounded(out.withColumn("recent_alerts", last))


@register(
    "minmax_scores",
    O.with_pred(f"""
, mm AS (SELECT model, min(p) AS mn, max(p) AS mx FROM pred GROUP BY model)
SELECT model, id, {r6('(p - mn) / (mx - mn + 1e-9)')} AS p_norm FROM pred JOIN mm USING (model)"""),
)
def q_minmax_scores(spark, sf_dir):
    # decision scores without probabilities are min-max scaled per model (+1e-9 in the divisor)
    pred = tables.predictions(spark, sf_dir)
    return rounded(metrics.minmax_normalise(pred, "p", "p_norm", by="model").select("model", "id", "p_norm"))
