"""Transaction tables derived from the driver's parquet tables.

``transactions``     events joined to embeddings: one labelled row per event with V1..V28.
``transactions_li``  lineitem seen as transactions (large, many Time ties, no V columns).
``predictions``      long (model, id, label, p) table with tied scores, for the metric operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.schema import V_COLUMNS


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def wallclock_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a TIMESTAMP_NTZ, from its fields.

    Field extraction of NTZ values involves no time zone, so the result is the
    same under any session time zone (a cast to TIMESTAMP would not be).
    """
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    sec_micros = (F.date_part(F.lit("SECOND"), ts) * 1000000).cast("bigint")
    return days * 86400000000 + F.hour(ts).cast("bigint") * 3600000000 + F.minute(ts).cast("bigint") * 60000000 + sec_micros


def seconds_since_first(df: DataFrame, ts_col: str) -> Column:
    """Seconds (double) from the table's earliest ``ts_col`` value.

    The minimum is one scalar aggregate, fetched once and inlined as a literal.
    """
    dtype = dict(df.dtypes)[ts_col]
    micros = wallclock_micros(F.col(ts_col)) if dtype == "timestamp_ntz" else F.unix_micros(F.col(ts_col))
    first = df.agg(F.min(micros).alias("t0")).first()["t0"]
    if first is None:
        return F.lit(None).cast("double")
    return (micros - F.lit(first)) / F.lit(1e6)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, Time, Amount, Class, V1..V28`` from events ⋈ embeddings.

    Each event takes vector ``event_id mod count(embeddings)``; ``Class`` is
    ``label = 0`` of that vector.  Only the 28 used vector elements are
    projected before the join, so a broadcast (chosen by Spark's size check on
    the pruned side) stays small; a large embeddings table falls back to a
    sort-merge join on the same key.
    """
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "value")
    emb = read_table(spark, sf_dir, "embeddings")
    n_vec = emb.count()
    vec = emb.select(
        "vec_id",
        (F.col("label") == 0).cast("int").alias("Class"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(V_COLUMNS)],
    )
    time = seconds_since_first(events, "ts")
    ev = events.select(
        F.col("event_id").alias("id"),
        time.alias("Time"),
        F.col("value").alias("Amount"),
        F.pmod(F.col("event_id"), F.lit(n_vec)).alias("_vec"),
    )
    return ev.join(vec, ev["_vec"] == vec["vec_id"]).select("id", "Time", "Amount", "Class", *V_COLUMNS)


def transactions_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Time, Amount, Class`` from lineitem (Class = returnflag 'R')."""
    li = read_table(spark, sf_dir, "lineitem").select("l_shipdate", "l_extendedprice", "l_returnflag")
    time = seconds_since_first(li, "l_shipdate")
    return li.select(
        time.alias("Time"),
        F.col("l_extendedprice").alias("Amount"),
        (F.col("l_returnflag") == "R").cast("int").alias("Class"),
    )


def fixture_probability(amount: Column) -> Column:
    """Amount/500 rounded half-up to 3 decimals, clipped to [0, 1].

    Done in integer arithmetic on cents (exact in every engine): milli =
    (2*cents + 5) div 10.  Returned as integer thousandths.
    """
    cents = F.round(amount * 100).cast("bigint")
    milli = F.floor((cents * 2 + 5) / 10).cast("bigint")
    return F.least(F.greatest(milli, F.lit(0)), F.lit(1000))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long evaluation table ``model, id, label, p`` with many tied scores.

    m1 scores ``p``; m2 scores ``1 - p`` (a weak, inverted model).
    """
    tx = transactions(spark, sf_dir).select("id", "Class", "Amount")
    milli = fixture_probability(F.col("Amount"))
    base = tx.select("id", F.col("Class").alias("label"), milli.alias("_m"))
    m1 = base.select(F.lit("m1").alias("model"), "id", "label", (F.col("_m") / 1000.0).alias("p"))
    m2 = base.select(F.lit("m2").alias("model"), "id", "label", ((1000 - F.col("_m")) / 1000.0).alias("p"))
    return m1.unionByName(m2)
