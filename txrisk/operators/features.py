"""Feature engineering: scaled, cyclical, rolling-window and interaction columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.operators.ordering import auto_block_rows, rolling_over_positions, spread, with_positions
from txrisk.operators.stats import FeatureStats, fit_feature_stats
from txrisk.schema import ENGINEERED_COLUMNS, FEATURE_COLUMNS, ROLLING_ROWS

TWO_PI = 2 * math.pi


def row_features(df: DataFrame, stats: FeatureStats) -> DataFrame:
    """Per-row features from fitted scalars (no ordering needed).

    Amount_scaled, Time_hours, Time_scaled, hour_sin, hour_cos, is_high_amount,
    V14_V17_interaction, V4_V11_interaction.
    """
    hours = F.col("Time") / 3600.0
    hour_of_day = F.pmod(hours, F.lit(24.0))
    std = F.lit(stats.hours_std).cast("double")
    return df.withColumns(
        {
            "Amount_scaled": (F.col("Amount") - F.lit(stats.amount_median)) / F.lit(float(stats.amount_scale)),
            "Time_hours": hours,
            "Time_scaled": F.try_divide(hours - F.lit(stats.hours_mean).cast("double"), std),
            "hour_sin": F.sin(F.lit(TWO_PI) * hour_of_day / 24.0),
            "hour_cos": F.cos(F.lit(TWO_PI) * hour_of_day / 24.0),
            "is_high_amount": (F.col("Amount") > F.lit(stats.amount_q95)).cast("int"),
            "V14_V17_interaction": F.col("V14") * F.col("V17"),
            "V4_V11_interaction": F.col("V4") * F.col("V11"),
        }
    )


def rolling_features(
    df: DataFrame,
    order_cols=("Time", "id"),
    rows: int = ROLLING_ROWS,
    block_rows: int | None = None,
) -> DataFrame:
    """tx_velocity, rolling_avg_amount, amount_deviation over the table ordered by Time.

    ``tx_velocity`` is the number of rows in the 100-row frame (min(position, 100));
    ``rolling_avg_amount`` is the frame mean with at least one row.  Ties of Time
    are broken by ``id``.  Runs on the block/halo plan of ``ordering``.
    """
    # frames are computed on (id, Time, Amount) only and joined back once on the unique id
    keys = list(order_cols)
    narrow = df.select(*dict.fromkeys(["id", *keys, "Amount"]))
    pos = with_positions(narrow, keys, pos_col="_tx_pos")
    n = pos.count()  # of the written positions
    block_rows = block_rows or auto_block_rows(pos, rows, n)
    frames = rolling_over_positions(pos, {"rolling_avg_amount": F.avg("Amount")}, rows, pos_col="_tx_pos", block_rows=block_rows)
    frames = frames.select("id", "_tx_pos", "rolling_avg_amount")
    out = spread(df, n, "id").join(spread(frames, n, "id"), "id")
    return out.withColumns(
        {
            "tx_velocity": F.least(F.col("_tx_pos") + 1, F.lit(rows)).cast("double"),
            "amount_deviation": F.abs(F.col("Amount") - F.col("rolling_avg_amount")),
        }
    ).drop("_tx_pos")


def engineer_features(
    df: DataFrame,
    stats: FeatureStats | None = None,
    rolling: bool = True,
    block_rows: int | None = None,
) -> tuple[DataFrame, FeatureStats]:
    """All engineered columns; statistics are fitted on ``df`` unless given.

    Pass stored ``stats`` to score new rows with the training-time scalars
    (a single new row then gets Amount_scaled, Time_scaled, etc. relative to
    the training data rather than to itself).
    """
    stats = stats or fit_feature_stats(df)
    out = row_features(df, stats)
    if rolling:
        out = rolling_features(out, block_rows=block_rows)
    return out, stats


def feature_columns() -> list[str]:
    return list(FEATURE_COLUMNS)


def engineered_columns() -> list[str]:
    return list(ENGINEERED_COLUMNS)
