"""Scoring tables into alerts: risk bands, decisions, ids, running totals, alert board."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions import risk as R
from txrisk.operators.ordering import attach_positions, positions_of
from txrisk.schema import DEFAULT_ALERT_FILTER, DEFAULT_THRESHOLD, RISK_LEVELS

LOG_COLUMNS = ["tx_id", "timestamp", "fraud_probability", "fraud_score", "risk_level", "decision", "threshold_used"]
BOARD_COLUMNS = ["tx_id", "timestamp", "fraud_score", "fraud_probability", "risk_level", "decision"]


def score(df: DataFrame, prob_col: str = "fraud_probability", threshold: float | Column = DEFAULT_THRESHOLD, with_alert: bool = False) -> DataFrame:
    """Add fraud_score, risk_level, decision and threshold_used (and the alert struct)."""
    p = F.col(prob_col)
    s = R.prob_to_score(p)
    cols = {
        "fraud_probability": p,
        "fraud_score": s,
        "risk_level": R.score_to_risk(s),
        "decision": R.decision(p, threshold),
        "threshold_used": R.clamp_threshold(threshold),
    }
    if with_alert:
        cols["alert"] = R.alert_struct(s)
    return df.withColumns(cols)


def assign_tx_ids(df: DataFrame, order_cols: Sequence[str], col: str = "tx_id", fmt: str = "TX_%06d", key: str = "id") -> DataFrame:
    """Ids by 1-based position in a global order (positions on the key columns, joined back on ``key``)."""
    pos = attach_positions(df, order_cols, key=key, pos_col="_txpos")
    return pos.withColumn(col, F.format_string(fmt, F.col("_txpos") + 1)).drop("_txpos")


def running_stats(scored: DataFrame, threshold: float | Column = DEFAULT_THRESHOLD) -> DataFrame:
    """Totals over scored rows (one global aggregation, constant-size state).

    fraud_detected counts risk FRAUD (not decision BLOCK); fraud_rate_pct divides by max(n, 1).
    """
    counts = [F.count_if(F.col("risk_level") == lvl).alias(f"n_{lvl.lower()}") for lvl in RISK_LEVELS]
    agg = scored.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.avg("fraud_score").alias("avg_score"),
        *counts,
    )
    n = F.col("total_processed")
    return agg.select(
        "total_processed",
        F.col("n_fraud").alias("fraud_detected"),
        F.coalesce(F.col("avg_score"), F.lit(0.0)).alias("avg_score"),
        *[F.col(f"n_{lvl.lower()}") for lvl in RISK_LEVELS],
        F.create_map(*[x for lvl in RISK_LEVELS for x in (F.lit(lvl), F.col(f"n_{lvl.lower()}"))]).alias("alert_distribution"),
        F.round(F.col("n_fraud") / F.greatest(n, F.lit(1)) * 100.0, 2).alias("fraud_rate_pct"),
        R.clamp_threshold(threshold).alias("current_threshold"),
    )


def risk_counts(log: DataFrame) -> DataFrame:
    """Alert-board header: total, SAFE/SUSPICIOUS/FRAUD counts (0 when absent), detection rate %."""
    agg = log.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.count_if(F.col("risk_level") == lvl).alias(f"n_{lvl.lower()}") for lvl in RISK_LEVELS],
    )
    return agg.withColumn(
        "detection_rate_pct", F.coalesce(F.try_divide(F.col("n_fraud"), F.col("total_alerts")) * 100.0, F.lit(0.0))
    )


def filter_risk(log: DataFrame, levels: Sequence[str] | None = tuple(DEFAULT_ALERT_FILTER)) -> DataFrame:
    """Keep the selected risk levels; an empty selection keeps every row."""
    if not levels or "risk_level" not in log.columns:
        return log
    return log.filter(F.col("risk_level").isin(list(levels)))


def alert_board(log: DataFrame, levels: Sequence[str] | None = tuple(DEFAULT_ALERT_FILTER), top: int = 100) -> DataFrame:
    """Top-``top`` alerts by score among the selected levels, display columns only.

    Ordered by fraud_score desc, then tx_id, so the cut at ``top`` is deterministic.
    """
    f = filter_risk(log, levels)
    cols = [c for c in BOARD_COLUMNS if c in f.columns]
    return f.select(*cols).orderBy(F.col("fraud_score").desc(), F.col("tx_id").asc()).limit(top)


def recent(log: DataFrame, k: int = 20, order_cols: Sequence[Column] | None = None) -> DataFrame:
    """The ``k`` newest predictions (timestamp desc, tx_id desc)."""
    order = order_cols or [F.col("timestamp").desc(), F.col("tx_id").desc()]
    return log.orderBy(*order).limit(k)


def first_n(df: DataFrame, n: int | None, order_cols: Sequence[str | Column]) -> DataFrame:
    """At most ``n`` transactions in stream order (None = all)."""
    return df if n is None else df.orderBy(*order_cols).limit(n)


# ---------------------------------------------------------------------------
# the same reports over a table that has no tx_id yet: few rows first, then their ids
# ---------------------------------------------------------------------------


def _with_ids_of(few: DataFrame, table: DataFrame, fmt: str = "TX_%06d") -> DataFrame:
    """The rows of ``few`` (a report of ``table``) with their ids by position in (Time, id) order.

    The rows pass the driver, so a report has a limit.  ``id`` must be unique.
    """
    rows = few.collect()
    at = positions_of(table, "Time", "id", [(r["Time"], r["id"]) for r in rows])
    schema = few.schema.add("tx_id", "string")
    return few.sparkSession.createDataFrame([(*r, fmt % (p + 1)) for r, p in zip(rows, at)], schema)


def table_board(scored: DataFrame, levels: Sequence[str] | None = tuple(DEFAULT_ALERT_FILTER), top: int = 100) -> DataFrame:
    """:func:`alert_board` of scored rows without ids; ties of the score in stream order (Time, id)."""
    few = filter_risk(scored, levels).orderBy(F.col("fraud_score").desc(), "Time", "id").limit(top)
    return _with_ids_of(few, scored).select(*[c for c in BOARD_COLUMNS if c == "tx_id" or c in few.columns])


def table_recent(scored: DataFrame, k: int = 20) -> DataFrame:
    """:func:`recent` of scored rows without ids: the last ``k`` in stream order."""
    return _with_ids_of(scored.orderBy(F.col("Time").desc(), F.col("id").desc()).limit(k), scored)


def table_head(scored: DataFrame, n: int) -> DataFrame:
    """:func:`first_n` of scored rows without ids: the first ``n`` in stream order."""
    few = scored.orderBy("Time", "id").limit(n)
    rows = few.collect()
    return scored.sparkSession.createDataFrame([(*r, "TX_%06d" % (p + 1)) for p, r in enumerate(rows)], few.schema.add("tx_id", "string"))
