"""Profiling tables behind the exploratory charts (class balance, time trends, histograms, box plots)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


HIGH_RATE_FLAG = 0.005  # hours whose fraud rate exceeds this are highlighted


def class_counts(df: DataFrame, label: str = "Class") -> DataFrame:
    """``Class, count, share_pct`` for classes 0 and 1 (0 when a class is absent).

    One global aggregation (partial per partition), then a 2-row unpivot.
    """
    agg = df.agg(
        F.count_if(F.col(label) == 0).alias("n0"),
        F.count_if(F.col(label) == 1).alias("n1"),
    )
    rows = agg.select(
        F.expr("stack(2, 0, n0, 1, n1) as (Class, count)"),
        (F.col("n0") + F.col("n1")).alias("_total"),
    )
    return rows.select(
        F.col("Class").cast("int").alias("Class"),
        F.col("count").cast("bigint").alias("count"),
        F.round(F.try_divide(F.col("count"), F.col("_total")) * 100.0, 3).alias("share_pct"),
    )


def hourly_volume(df: DataFrame, label: str = "Class") -> DataFrame:
    """Per whole hour since the first transaction: total, fraud, legit."""
    binned = df.select(F.floor(F.col("Time") / 3600.0).alias("time_bin"), F.col(label).alias("_y"))
    return binned.groupBy("time_bin").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("_y").cast("bigint").alias("fraud"),
    ).withColumn("legit", F.col("total") - F.col("fraud"))


def fraud_rate_by_hour(df: DataFrame, label: str = "Class") -> DataFrame:
    """Per hour of day (0..23): fraud_rate = mean label, count, highlighted = rate > 0.005."""
    hour = F.floor(F.pmod(F.col("Time") / 3600.0, F.lit(24.0))).cast("int")
    g = df.select(hour.alias("hour_int"), F.col(label).alias("_y")).groupBy("hour_int")
    out = g.agg(F.avg("_y").alias("fraud_rate"), F.count(F.lit(1)).alias("count"))
    return out.withColumn("highlighted", F.col("fraud_rate") > F.lit(HIGH_RATE_FLAG))


def log_edges(lo_value: float, hi_value: float, n_edges: int = 50) -> list[float]:
    """``10 ** linspace(log10(max(lo, 0.01)), log10(hi), n)``; the last exponent is exactly log10(hi)."""
    lo = math.log10(max(lo_value, 0.01))
    hi = math.log10(hi_value)
    step = (hi - lo) / float(n_edges - 1)
    return [10.0 ** (hi if i == n_edges - 1 else i * step + lo) for i in range(n_edges)]


def amount_histogram(df: DataFrame, label: str = "Class", n_edges: int = 50) -> DataFrame:
    """Log-spaced Amount histogram per class, density-normalised per class.

    Edges: :func:`log_edges` over the table's min/max (two scalars, inlined as a
    50-element literal).  A value falls into bin i when edge_i <= v < edge_{i+1};
    the last bin also takes v == max; values below the first edge are out of
    range.  density = count / (in-range count of the class * bin width).
    Output: Class, bin, lo, hi, count, density.
    """
    mm = df.agg(F.min("Amount").alias("mn"), F.max("Amount").alias("mx")).first()
    if mm["mx"] is None or mm["mx"] <= 0:
        return df.sparkSession.createDataFrame([], "Class int, bin int, lo double, hi double, count bigint, density double")
    last = n_edges - 1
    values = log_edges(mm["mn"], mm["mx"], n_edges)
    edges, v = F.array(*[F.lit(e) for e in values]), F.col("Amount")
    # bin = number of edges <= v, minus one.  The logarithm gives it but for rounding, so the guess is
    # corrected by one against the edges; the right edge closes the last bin
    step = math.log10(values[1] / values[0])
    guess = F.floor(F.log10(v / values[0]) / step) if step > 0 else F.lit(last)
    near = F.greatest(F.lit(0), F.least(F.lit(last), guess)).cast("int")
    up, down = F.get(edges, near + 1) <= v, F.get(edges, near) > v
    idx = F.when(v < values[0], -1).when(up, near + 1).when(down, near - 1).otherwise(near)
    binned = df.filter(v.isNotNull()).select(F.col(label).alias("Class"), F.least(idx, F.lit(last - 1)).alias("bin")).filter(F.col("bin") >= 0)
    counts = binned.groupBy("Class", "bin").agg(F.count(F.lit(1)).alias("count"))
    per_class = Window.partitionBy("Class")  # <= classes x 49 bins: tiny
    lo = F.element_at(edges, F.col("bin") + 1)
    hi = F.element_at(edges, F.col("bin") + 2)
    return counts.select(
        F.col("Class").cast("int").alias("Class"),
        F.col("bin").cast("int").alias("bin"),
        lo.alias("lo"),
        hi.alias("hi"),
        "count",
        (F.col("count") / (F.sum("count").over(per_class) * (hi - lo))).alias("density"),
    )


def amount_boxplot(df: DataFrame, label: str = "Class", cap_quantile: float = 0.99) -> DataFrame:
    """Box-plot numbers of Amount per class after capping at the class's 99th percentile.

    q1/median/q3 are linear-interpolation quantiles of the capped values;
    whiskers are the most extreme capped values within 1.5 IQR of the box;
    n_fliers counts values outside the whiskers.  Capping keeps the order, so the order statistics of
    the capped values are the capped order statistics and all quantiles come from one
    :func:`order_values`; the per-class scalars (one row per class) are inlined as literal maps.
    """
    from txrisk.operators.stats import between, order_values

    keyed = df.select(F.col(label).alias("Class"), "Amount").filter(F.col("Amount").isNotNull())
    at = order_values(keyed.select(F.col("Class").alias("_g"), F.col("Amount").alias("_v")), [cap_quantile, 0.25, 0.5, 0.75])
    if not at:
        return df.sparkSession.createDataFrame([], "Class int, n long, q1 double, median double, q3 double, whislo double, whishi double, n_fliers long")
    caps = {g: between(*ws[0]) for g, ws in at.items()}
    box = {g: [between(min(a, caps[g]), min(b, caps[g]), f) for a, b, f in ws[1:]] for g, ws in at.items()}

    def lookup(values: dict):
        return F.create_map(*[x for g, v in values.items() for x in (F.lit(g), F.lit(float(v)))])[F.col("Class")]

    capped = keyed.select("Class", F.least(F.col("Amount"), lookup(caps)).alias("v"))
    q1 = {g: q[0] for g, q in box.items()}
    med = {g: q[1] for g, q in box.items()}
    q3 = {g: q[2] for g, q in box.items()}
    lo = {g: q1[g] - 1.5 * (q3[g] - q1[g]) for g in box}
    hi = {g: q3[g] + 1.5 * (q3[g] - q1[g]) for g in box}
    inside = (F.col("v") >= lookup(lo)) & (F.col("v") <= lookup(hi))
    w = capped.groupBy("Class").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("v"))).alias("whislo"),
        F.max(F.when(inside, F.col("v"))).alias("whishi"),
        F.count_if(~inside).alias("n_fliers"),
    )
    return w.select(
        F.col("Class").cast("int").alias("Class"),
        "n",
        lookup(q1).alias("q1"),
        lookup(med).alias("median"),
        lookup(q3).alias("q3"),
        "whislo",
        "whishi",
        "n_fliers",
    )


def score_histogram(pred: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram of 100*p per (model, label): 50 bins of width 2 on [0, 100], density per group.

    Output: model, label, bin, count, density.
    """
    s = F.col("p") * 100.0
    width = 100.0 / bins
    b = F.least(F.floor(s / width), F.lit(bins - 1)).cast("int")
    keyed = pred.filter((s >= 0) & (s <= 100)).select("model", "label", b.alias("bin"))
    counts = keyed.groupBy("model", "label", "bin").agg(F.count(F.lit(1)).alias("count"))
    grp = Window.partitionBy("model", "label")  # <= bins rows per group
    return counts.withColumn("density", F.col("count") / (F.sum("count").over(grp) * width))
