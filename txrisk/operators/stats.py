"""Exact statistics: quantiles, dataset profile, fitted feature statistics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.session import checkpoint_dir, shuffle_partitions


def order_values(vals: DataFrame, probs: Sequence[float]) -> dict:
    """The order statistics around each quantile of ``_v`` per ``_g``: {group: [(lower, upper, fraction), ...]}.

    One plan for every size.  Rows collapse to (group, value, count), so equal values are one row whatever their
    number; these are ranged over (group, value) and written once to the shared folder.  The counts of
    the range partitions (partitions x groups rows, groups being few: labels or column names) tell which
    partitions hold the wanted ranks, and only those are read again.  NULL values are ignored.
    """
    spark = vals.sparkSession
    hist = vals.filter(F.col("_v").isNotNull()).groupBy("_g", F.col("_v").cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/txrisk-quantiles/{uuid.uuid4().hex}"
    ranged = hist.repartitionByRange(shuffle_partitions(spark), "_g", "_v").withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    parts: dict = {}
    for r in ranged.groupBy("_g", "_part").agg(F.sum("_n").alias("n")).collect():
        parts.setdefault(r["_g"], []).append((r["_part"], r["n"]))
    if not parts:
        return {}
    wanted: dict = {}  # group -> [(lower rank, upper rank, fraction)]
    places: dict = {}  # (group, rank) -> (partition, rank inside it)
    for g, counts in parts.items():
        counts.sort()
        total = sum(n for _, n in counts)
        for p in probs:
            h = p * (total - 1)
            lo = int(h // 1)
            wanted.setdefault(g, []).append((lo, min(lo + 1, total - 1), h - lo))
        for rank in {i for lo, hi, _ in wanted[g] for i in (lo, hi)}:
            rest = rank
            for part, n in counts:
                if rest < n:
                    places[(g, rank)] = (part, rest)
                    break
                rest -= n
    upto = F.sum("_n").over(Window.partitionBy("_g", "_part").orderBy("_v"))
    near = ranged.filter(F.col("_part").isin(sorted({p for p, _ in places.values()}))).withColumn("_upto", upto)
    hit = F.lit(False)
    for (g, _), (part, rest) in places.items():
        here = F.col("_g").eqNullSafe(F.lit(g)) & (F.col("_part") == part)
        hit = hit | (here & (F.col("_upto") > rest) & (F.col("_upto") - F.col("_n") <= rest))
    found: dict = {}
    for r in near.filter(hit).collect():
        found.setdefault((r["_g"], r["_part"]), []).append((r["_upto"] - r["_n"], r["_upto"], r["_v"]))

    def value(g, rank: int) -> float:
        part, rest = places[(g, rank)]
        return next(v for first, end, v in found[(g, part)] if first <= rest < end)

    return {g: [(value(g, lo), value(g, hi), f) for lo, hi, f in ws] for g, ws in wanted.items()}


def between(lower: float, upper: float, fraction: float) -> float:
    """Linear interpolation between two order statistics."""
    return lower + fraction * (upper - lower)


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """Exact linear-interpolation quantiles (pandas/numpy 'linear', SQL quantile_cont) of several columns.

    NULLs are ignored; a column without values yields None.  All columns go through one plan.
    """
    if not cols:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("_g"), F.col(c).cast("double").alias("_v")) for c in cols])
    at = order_values(df.select(F.explode(pairs).alias("_p")).select("_p.*"), probs)
    return {c: [between(*w) for w in at[c]] if c in at else [None for _ in probs] for c in cols}


def quantiles_by(df: DataFrame, group_col: str, value_col: str, probs: Sequence[float]) -> dict:
    """Exact linear quantiles of ``value_col`` per value of a low-cardinality ``group_col``: {group: [q...]}."""
    at = order_values(df.select(F.col(group_col).alias("_g"), F.col(value_col).alias("_v")), probs)
    return {g: [between(*w) for w in ws] for g, ws in at.items()}


def dataset_stats(df: DataFrame, label: str = "Class") -> DataFrame:
    """One-row profile: counts, fraud share, imbalance, Amount describe(), time range.

    ``amount_*`` quantiles are exact (see :func:`quantiles`), std is the sample std.
    """
    probs = [0.25, 0.5, 0.75]
    q = F.array(*[F.lit(v).cast("double") for v in quantiles(df, ["Amount"], probs)["Amount"]])
    agg = df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.coalesce(F.sum(F.col(label)), F.lit(0)).cast("bigint").alias("fraud_count"),
        F.count("Amount").cast("double").alias("amount_count"),
        F.avg("Amount").alias("amount_mean"),
        F.stddev_samp("Amount").alias("amount_std"),
        F.min("Amount").cast("double").alias("amount_min"),
        F.max("Amount").cast("double").alias("amount_max"),
        (F.max("Time") - F.min("Time")).alias("_trange"),
        q.alias("_q"),
    )
    total, fraud = F.col("total_transactions"), F.col("fraud_count")
    return agg.select(
        total,
        fraud,
        (total - fraud).alias("legitimate_count"),
        F.round(F.try_divide(fraud, total) * 100.0, 4).alias("fraud_rate_pct"),
        F.round(F.try_divide(total - fraud, F.greatest(fraud, F.lit(1))), 1).alias("imbalance_ratio"),
        "amount_count",
        "amount_mean",
        "amount_std",
        "amount_min",
        F.col("_q")[0].alias("amount_p25"),
        F.col("_q")[1].alias("amount_p50"),
        F.col("_q")[2].alias("amount_p75"),
        "amount_max",
        F.round(F.col("_trange") / 3600.0, 1).alias("time_range_hours"),
    )


def dataset_stats_record(stats: DataFrame) -> DataFrame:
    """Nested form of :func:`dataset_stats` for the JSON sink (``amount_stats`` struct)."""
    return stats.select(
        "total_transactions",
        "fraud_count",
        "legitimate_count",
        "fraud_rate_pct",
        "imbalance_ratio",
        F.struct(
            F.col("amount_count").alias("count"),
            F.col("amount_mean").alias("mean"),
            F.col("amount_std").alias("std"),
            F.col("amount_min").alias("min"),
            F.col("amount_p25").alias("25%"),
            F.col("amount_p50").alias("50%"),
            F.col("amount_p75").alias("75%"),
            F.col("amount_max").alias("max"),
        ).alias("amount_stats"),
        "time_range_hours",
    )


@dataclass
class FeatureStats:
    """Scalars fitted once and reused for batch, stream and single records."""

    amount_median: float
    amount_iqr: float
    amount_q95: float
    hours_mean: float | None
    hours_std: float | None
    n_rows: int

    @property
    def amount_scale(self) -> float:
        # zero spread -> divisor 1 (robust scaling convention)
        return self.amount_iqr if self.amount_iqr not in (0.0, None) else 1.0

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, s: str) -> "FeatureStats":
        return cls(**json.loads(s))


def fit_feature_stats(df: DataFrame) -> FeatureStats:
    """Fit Amount quartiles/95th percentile and the mean/sample std of Time in hours."""
    hours = F.col("Time") / 3600.0
    q = quantiles(df, ["Amount"], [0.25, 0.5, 0.75, 0.95])["Amount"]
    row = df.agg(F.avg(hours).alias("m"), F.stddev_samp(hours).alias("s"), F.count(F.lit(1)).alias("n")).first()
    iqr = (q[2] - q[0]) if q[0] is not None else None
    return FeatureStats(
        amount_median=q[1],
        amount_iqr=iqr,
        amount_q95=q[3],
        hours_mean=row["m"],
        hours_std=row["s"],
        n_rows=row["n"],
    )
