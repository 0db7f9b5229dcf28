"""Column names, types and fixed lookup values of the transaction data model."""

from __future__ import annotations

from pyspark.sql import types as T

V_COLUMNS = [f"V{i}" for i in range(1, 29)]

# Canonical raw layout: any input is reduced to these columns in this order.
EXPECTED_COLUMNS = ["Time", "Amount", "Class"] + V_COLUMNS
NUMERIC_COLUMNS = ["Time", "Amount"] + V_COLUMNS
LABEL = "Class"

RAW_SCHEMA = T.StructType(
    [T.StructField("Time", T.DoubleType()), T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in V_COLUMNS]
)

# Input of the scoring job: raw features without a label, optional caller id.
SCORING_SCHEMA = T.StructType(
    [T.StructField("Time", T.DoubleType()), T.StructField("Amount", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in V_COLUMNS]
    + [T.StructField("tx_id", T.StringType())]
)

ENGINEERED_COLUMNS = [
    "Amount_scaled",
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

# Model input, ordered: 28 V columns then the 10 engineered ones.
FEATURE_COLUMNS = V_COLUMNS + ENGINEERED_COLUMNS

ROLLING_ROWS = 100
HIGH_AMOUNT_QUANTILE = 0.95

# ---------------------------------------------------------------------------
# Fixed values (must equal the published behaviour).
# ---------------------------------------------------------------------------

# Display names of the engineered features; V<i> shows as "PCA Component V<i>".
ENGINEERED_DISPLAY_NAMES = {
    "Amount_scaled": "Transaction Amount (normalized)",
    "Time_scaled": "Transaction Time (normalized)",
    "hour_sin": "Hour of Day (sin)",
    "hour_cos": "Hour of Day (cos)",
    "tx_velocity": "Transaction Velocity (recent 100)",
    "rolling_avg_amount": "Rolling Avg Amount",
    "amount_deviation": "Amount Deviation from Average",
    "is_high_amount": "High-Value Transaction Flag",
    "V14_V17_interaction": "V14 × V17 Interaction",
    "V4_V11_interaction": "V4 × V11 Interaction",
}

# Risk bands on the 0-100 score: score < 30 SAFE, < 70 SUSPICIOUS, otherwise FRAUD.
SAFE_BELOW = 30.0
SUSPICIOUS_BELOW = 70.0
RISK_LEVELS = ["SAFE", "SUSPICIOUS", "FRAUD"]

# Alert metadata per risk level: (color, icon, description, action).
ALERT_METADATA = {
    "SAFE": ("#22c55e", "✅", "Transaction appears legitimate. No action required.", "APPROVE"),
    "SUSPICIOUS": ("#f59e0b", "⚠️", "Transaction shows unusual patterns. Manual review recommended.", "REVIEW"),
    "FRAUD": ("#ef4444", "🚨", "HIGH PROBABILITY of fraudulent activity. Block and investigate immediately.", "BLOCK"),
}

# Threshold limits of the decision rule.
THRESHOLD_MIN = 0.01
THRESHOLD_MAX = 0.99
DEFAULT_THRESHOLD = 0.5

# Default risk selection of the alert board.
DEFAULT_ALERT_FILTER = ["SUSPICIOUS", "FRAUD"]


def display_name(feature: str) -> str:
    if feature in ENGINEERED_DISPLAY_NAMES:
        return ENGINEERED_DISPLAY_NAMES[feature]
    return f"PCA Component {feature}"


PREDICTION_LOG_SCHEMA = T.StructType(
    [
        T.StructField("tx_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("fraud_probability", T.DoubleType()),
        T.StructField("fraud_score", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("threshold_used", T.DoubleType()),
    ]
)
