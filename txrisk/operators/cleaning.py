"""Cleaning: non-finite values, label validity, median imputation, missing columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.schema import LABEL, NUMERIC_COLUMNS


def finite_or_null(c: str | Column) -> Column:
    """NaN, +inf and -inf become NULL (Spark keeps NaN distinct from NULL)."""
    col = F.col(c) if isinstance(c, str) else c
    bad = F.isnan(col) | (col == F.lit(float("inf"))) | (col == F.lit(float("-inf")))
    return F.when(bad, F.lit(None)).otherwise(col)


def nonfinite_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = [c for c in (cols or NUMERIC_COLUMNS) if c in df.columns]
    types = dict(df.dtypes)
    return df.withColumns({c: finite_or_null(c) for c in cols if types[c] in ("double", "float")})


def keep_valid_labels(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Keep rows whose label is 0 or 1 (NULL and any other value are dropped)."""
    return df.filter(F.col(label).isin(0, 1))


def median_impute(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill NULLs of each column with that column's median (over the rows given).

    The medians are one aggregation; an all-NULL column has no median and stays NULL.
    """
    from txrisk.operators.stats import quantiles

    cols = [c for c in (cols or NUMERIC_COLUMNS) if c in df.columns]
    if not cols:
        return df
    missing = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in cols]).first()
    cols = [c for c in cols if missing[c]]  # only columns with nulls need their median
    if not cols:
        return df
    med = quantiles(df, cols, [0.5])
    fill = {c: med[c][0] for c in cols if med[c][0] is not None}
    return df.fillna(fill) if fill else df


def clean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Ingest cleaning in the published order: non-finite -> NULL, invalid labels dropped, median fill."""
    return median_impute(keep_valid_labels(nonfinite_to_null(df, cols)), cols)


def fill_missing_columns(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """Add absent columns as a constant (engineered features missing at scoring time)."""
    missing = {c: F.lit(float(value)) for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df


def null_to_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL (missing) feature values of a record count as 0; NaN stays NaN (``fillna`` would zero it too)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols if c in df.columns})


def project_available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Select the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])
