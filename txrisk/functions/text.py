"""Explanation wording as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (wording of the published explanation text).
# ---------------------------------------------------------------------------
HEADER = "Risk Assessment: %s (Fraud Probability: %.1f%%)"
FACTORS_TITLE = "Key Factors Driving This Prediction:"
FACTOR_LINE = "  • %s: value=%.3f — %s %s fraud risk"
INCREASES = "↑ increases"
DECREASES = "↓ decreases"
STRONG, MODERATE, SLIGHT = "strongly", "moderately", "slightly"
STRONG_ABOVE, MODERATE_ABOVE = 0.3, 0.1


def direction(contribution: Column) -> Column:
    return F.when(contribution > 0, F.lit(INCREASES)).otherwise(F.lit(DECREASES))


def strength(contribution: Column) -> Column:
    a = F.abs(contribution)
    return F.when(a > STRONG_ABOVE, F.lit(STRONG)).when(a > MODERATE_ABOVE, F.lit(MODERATE)).otherwise(F.lit(SLIGHT))


def explanation_text(risk: Column, prob: Column, factors: Column) -> Column:
    """Header, blank line, title, then one line per factor struct (feature, contribution, value)."""
    head = F.format_string(HEADER, risk, prob * 100.0)
    lines = F.transform(
        factors,
        lambda f: F.format_string(FACTOR_LINE, f["feature"], f["value"], strength(f["contribution"]), direction(f["contribution"])),
    )
    return F.array_join(F.concat(F.array(head, F.lit(""), F.lit(FACTORS_TITLE)), lines), "\n")
