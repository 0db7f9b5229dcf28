"""Batch scoring jobs: features with stored statistics -> model -> score, risk, alert, decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.operators import alerts
from txrisk.operators.cleaning import fill_missing_columns, null_to_zero
from txrisk.operators.features import engineer_features
from txrisk.operators.ordering import with_content_ids
from txrisk.operators.stats import FeatureStats
from txrisk.plans.models import probability_of_fraud
from txrisk.schema import DEFAULT_THRESHOLD, FEATURE_COLUMNS, NUMERIC_COLUMNS


def featurize(df: DataFrame, stats: FeatureStats, order_cols: Sequence[str] = ("Time", "id")) -> DataFrame:
    """Engineered columns with training-time scalars; rolling frames over ``df`` in (Time, id) order."""
    if "id" not in df.columns:
        df = with_content_ids(df)
    out, _ = engineer_features(df, stats)
    return fill_missing_columns(out, FEATURE_COLUMNS)


def score_table(model, df: DataFrame, stats: FeatureStats, threshold: float = DEFAULT_THRESHOLD, keep: Sequence[str] = ("id",),
                with_alert: bool = True) -> DataFrame:
    """Score every row: fraud_probability, fraud_score, risk_level, decision, threshold_used (+ alert struct)."""
    feats = featurize(df, stats)
    pred = probability_of_fraud(model.transform(feats))
    cols = [c for c in keep if c in pred.columns]
    return alerts.score(pred.select(*cols, "fraud_probability"), threshold=threshold, with_alert=with_alert)


def invalid_reason(cols: Sequence[str]) -> F.Column:
    """Names of NULL / NaN / infinite inputs, or NULL when the row is valid."""
    bad = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(c)) for c in cols]
    names = F.concat_ws(", ", *bad)
    return F.when(names != "", F.concat(F.lit("invalid or missing features: "), names))


def score_records(model, records: DataFrame, stats: FeatureStats, threshold: float = DEFAULT_THRESHOLD,
                  missing_as_zero: bool = False) -> DataFrame:
    """Batch prediction with a per-row error instead of a failed job.

    Valid rows get ``tx_id, fraud_probability, fraud_score, risk_level, decision``;
    rows with a NULL/NaN/inf input get ``tx_id, error``.  ``missing_as_zero``
    treats NULL inputs as 0 instead (lenient record path).  Records are told
    apart by their content, so scores do not depend on partitions; a record
    without a ``tx_id`` gets one from its content.
    """
    raw = [c for c in NUMERIC_COLUMNS if c in records.columns]
    recs = with_content_ids(records.drop("id"))
    if "tx_id" not in recs.columns:
        recs = recs.withColumn("tx_id", F.lit(None).cast("string"))
    recs = recs.withColumn("tx_id", F.coalesce(F.col("tx_id").cast("string"), F.concat(F.lit("TX_"), F.substring("id", 1, 12), F.regexp_extract("id", "-.*$", 0))))
    if missing_as_zero:
        recs = null_to_zero(fill_missing_columns(recs, NUMERIC_COLUMNS), NUMERIC_COLUMNS)
        raw = list(NUMERIC_COLUMNS)
    recs = recs.withColumn("error", invalid_reason(raw))
    valid = recs.filter(F.col("error").isNull()).drop("error")
    bad = recs.filter(F.col("error").isNotNull()).select("tx_id", "error")
    scored = score_table(model, valid, stats, threshold, keep=("tx_id",), with_alert=False)
    scored = scored.select("tx_id", "fraud_probability", "fraud_score", "risk_level", "decision")
    return scored.unionByName(bad, allowMissingColumns=True)


def alert_page(spark, log_dir: str, levels=("SUSPICIOUS", "FRAUD"), top: int = 100):
    """The alert board over the prediction log: (header counts, top alerts) of the most recent log day.

    Malformed log lines are skipped; an empty selection of levels keeps every level.
    """
    from txrisk.sources.artifacts import read_latest_log

    latest = read_latest_log(spark, log_dir)
    return alerts.risk_counts(latest), alerts.alert_board(latest, levels, top)
