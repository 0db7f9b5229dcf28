"""Global importance tables and local perturbation explanations for whole tables of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.functions import risk as R
from txrisk.functions.hashing import normal
from txrisk.functions.text import explanation_text
from txrisk.operators.knn import vector
from txrisk.schema import FEATURE_COLUMNS, display_name

NOISE_FACTOR = 0.1
NOISE_FLOOR = 1e-8
MIN_STD = 1e-10


def importance_table(spark: SparkSession, features: Sequence[str], values: Sequence[float]) -> DataFrame:
    """``feature, importance, importance_pct, rank`` from a raw importance vector (one row per feature)."""
    rows = [(f, float(v), i) for i, (f, v) in enumerate(zip(features, values))]
    df = spark.createDataFrame(rows, "feature string, raw double, position int")
    return rank_importance(df)


def rank_importance(df: DataFrame, value_col: str = "raw") -> DataFrame:
    """Normalise to sum 1, percent with 2 decimals, 1-based unique rank by importance desc (ties: list position)."""
    allw = Window.partitionBy()  # one row per feature: bounded by the feature count
    norm = df.withColumn("importance", F.col(value_col) / F.sum(value_col).over(allw))
    order = Window.orderBy(F.col("importance").desc(), F.col("position").asc())
    return norm.select(
        "feature",
        "importance",
        F.round(F.col("importance") * 100.0, 2).alias("importance_pct"),
        F.row_number().over(order).cast("int").alias("rank"),
    )


def top_features(imp: DataFrame, n: int = 20) -> DataFrame:
    """Top-n by rank, listed ascending for display, with feature group and display name."""
    top = imp.filter(F.col("rank") <= n)
    names = F.create_map(*[x for f in FEATURE_COLUMNS for x in (F.lit(f), F.lit(display_name(f)))])
    return top.select(
        "*", R.feature_group(F.col("feature")).alias("group"), F.coalesce(names[F.col("feature")], F.col("feature")).alias("display_name")
    ).orderBy(F.col("importance").asc(), F.col("rank").desc())


def noise_scale(x: Column) -> Column:
    """Population std over one row's feature array * 0.1 + 1e-8."""
    n = F.size(x).cast("double")
    mean = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / n
    var = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / n
    return F.sqrt(var) * NOISE_FACTOR + NOISE_FLOOR


FLAT_RELATIVE = 1e-10


def _flat(x: Column) -> Column:
    # merged partial aggregates leave ~1e-15 of "spread" on a constant column: treat it as none
    return F.stddev_pop(x) <= F.lit(FLAT_RELATIVE) * F.greatest(F.lit(1.0), F.abs(F.avg(x)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; (numerically) zero variance or undefined -> 0.

    ``corr`` would raise under ANSI on zero variance, and a constant column does
    not come out with an exactly zero spread after partial aggregation.
    """
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(_flat(a) | _flat(b), F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0)))


def explain_local(
    model,
    rows: DataFrame,
    feature_cols: Sequence[str] = FEATURE_COLUMNS,
    id_col: str = "tx_id",
    n_perturbations: int = 500,
    seed: int = 42,
    top: int = 10,
    text_top: int = 5,
) -> DataFrame:
    """Perturbation explanation of every row of ``rows``.

    Each row gets ``n_perturbations`` Gaussian perturbations (scale = its
    feature std * 0.1 + 1e-8, hashed from (seed, row, draw, feature)); the
    model scores them in one distributed transform; the contribution of a
    feature is the correlation of its noise with the change in probability.
    Output: id, fraud_probability, fraud_score, risk_level, top_features
    (array of feature/contribution/value/abs_contribution, by |contribution|),
    explanation_text (top 5).
    """
    from txrisk.plans.models import probability_of_fraud

    feats = list(feature_cols)
    d = len(feats)
    base = probability_of_fraud(model.transform(rows.select(id_col, *feats)), "_p0").select(id_col, *feats, "_p0")
    base = base.withColumn("_scale", noise_scale(vector(feats)))
    own = [F.col(f).alias(f"_x{i}") for i, f in enumerate(feats)]
    draws = base.select(id_col, *own, "_scale", "_p0", F.explode(F.sequence(F.lit(0), F.lit(n_perturbations - 1))).alias("_k"))
    # A column for each number and one projection for them all: Spark compiles so wide a projection in small methods,
    # where narrower ones in a row become a single method too long for the JVM to compile (4 times slower per draw).
    noise = [normal(seed, F.col(id_col), F.col("_k"), F.lit(i)) * F.col("_scale") for i in range(d)]
    moved = draws.select(
        id_col, "_p0", *[f"_x{i}" for i in range(d)],
        *[e.alias(f"_e{i}") for i, e in enumerate(noise)],
        *[(F.col(f"_x{i}") + e).alias(f) for i, (f, e) in enumerate(zip(feats, noise))],
    )
    scored = probability_of_fraud(model.transform(moved), "_p").withColumn("_dp", F.col("_p") - F.col("_p0"))
    aggs = []
    for i in range(d):
        e = F.col(f"_e{i}")
        aggs.append(F.when(F.stddev_pop(e) > MIN_STD, correlation(e, F.col("_dp"))).otherwise(F.lit(0.0)).alias(f"_c{i}"))
    # the row's own values and probability travel along: no second model pass, no join; as numbers, because an array
    # in the aggregation state would make it sort all draws
    j = scored.groupBy(id_col).agg(F.first("_p0").alias("_p0"), *[F.first(f"_x{i}").alias(f"_x{i}") for i in range(d)], *aggs)
    entries = F.array(
        *[
            F.struct(
                (-F.abs(F.col(f"_c{i}"))).alias("k"),
                F.lit(i).alias("pos"),
                F.lit(f).alias("feature"),
                F.col(f"_c{i}").alias("contribution"),
                F.col(f"_x{i}").alias("value"),
                F.abs(F.col(f"_c{i}")).alias("abs_contribution"),
            )
            for i, f in enumerate(feats)
        ]
    )
    ranked = F.transform(F.array_sort(entries), lambda s: F.struct(s["feature"], s["contribution"], s["value"], s["abs_contribution"]))
    out = j.select(id_col, F.col("_p0").alias("fraud_probability"), ranked.alias("_all"))
    s = R.prob_to_score(F.col("fraud_probability"))
    out = out.select(
        id_col,
        "fraud_probability",
        s.alias("fraud_score"),
        R.score_to_risk(s).alias("risk_level"),
        F.slice("_all", 1, top).alias("top_features"),
        F.slice("_all", 1, text_top).alias("_text_top"),
    )
    return out.withColumn("explanation_text", explanation_text(F.col("risk_level"), F.col("fraud_probability"), F.col("_text_top"))).drop(
        "_text_top"
    )
