import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txrisk.operators.ordering import rolling_aggregate, running_sums, with_positions


def _table(spark, n, ties=False):
    t = F.floor(F.col("id") / 7) if ties else F.col("id") * 3 % 1001
    return spark.range(n).select(F.col("id"), t.cast("double").alias("Time"), (F.col("id") * 37 % 101 / 4.0).alias("Amount"))


@pytest.mark.parametrize("n", [1, 99, 100, 101, 2500])
@pytest.mark.parametrize("block", [100, 128, 1000])
def test_rolling_equals_plain_window(spark, n, block):
    df = _table(spark, n, ties=(n % 2 == 1))
    got = rolling_aggregate(df, ["Time", "id"], {"ra": F.avg("Amount"), "rc": F.count(F.lit(1))}, 100, block_rows=block, num_partitions=5)
    w = Window.orderBy("Time", "id")
    exp = df.select("id", F.avg("Amount").over(w.rowsBetween(-99, 0)).alias("ea"), (F.row_number().over(w) - 1).alias("ep"))
    j = got.join(exp, "id").select(
        F.max(F.abs(F.col("ra") - F.col("ea"))).alias("d"), F.sum((F.col("_pos") != F.col("ep")).cast("int")).alias("bad"),
        F.count("*").alias("n"), F.max("rc").alias("mx"),
    ).first()
    assert j["n"] == n and j["bad"] == 0 and j["d"] < 1e-9
    assert j["mx"] == min(n, 100)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_positions_in_groups_any_partitioning(spark, parts):
    df = _table(spark, 3000, ties=True).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    got = with_positions(df, ["Time", "id"], group_cols=["g"], num_partitions=parts)
    w = Window.partitionBy("g").orderBy("Time", "id")
    exp = df.select("id", (F.row_number().over(w) - 1).alias("ep"))
    assert got.join(exp, "id").filter(F.col("_pos") != F.col("ep")).count() == 0


def test_running_sums_desc_with_groups(spark):
    df = _table(spark, 4000).withColumn("g", F.col("id") % 2)
    got = running_sums(df, [F.col("Amount").desc(), "id"], ["Amount"], group_cols=["g"], block_rows=333)
    w = Window.partitionBy("g").orderBy(F.col("Amount").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("id", F.sum("Amount").over(w).alias("e"))
    d = got.join(exp, "id").select(F.max(F.abs(F.col("Amount_cum") - F.col("e")))).first()[0]
    assert d < 1e-6


def test_range_partitions_are_not_single_task(spark):
    df = _table(spark, 1000)
    out = rolling_aggregate(df, ["Time", "id"], {"ra": F.avg("Amount")}, 100)
    # the numbered rows were written range-partitioned: several files of like size, each a range of the order
    parts = [spark.read.parquet(f).agg(F.count(F.lit(1)), F.min(F.struct("Time", "id")), F.max(F.struct("Time", "id"))).first() for f in out.inputFiles()]
    parts = sorted((p for p in parts if p[0]), key=lambda p: p[1])
    assert len(parts) >= 4 and max(p[0] for p in parts) <= 2 * 1000 / len(parts)
    assert all(x[2] < y[1] for x, y in zip(parts, parts[1:]))
    # rows are windowed per block; only the offsets table (one row per range partition) is gathered
    plan = out._jdf.queryExecution().toString()
    assert "hashpartitioning(_blk" in plan


def test_positions_do_not_depend_on_the_cache(spark):
    """Clearing the cache between building and running, and building twice, change nothing."""
    from pyspark.sql import functions as F

    from txrisk.operators.ordering import rolling_aggregate

    df = spark.range(3000).select(F.col("id"), (F.xxhash64("id") % 50).alias("t"), (F.col("id") * 7 % 101).cast("double").alias("v")).repartition(7)
    a, b = (rolling_aggregate(df, ["t", "id"], {"m": F.avg("v")}, rows=100) for _ in range(2))
    spark.catalog.clearCache()
    rows = [{r.id: (r._pos, r.m) for r in x.collect()} for x in (a, b)]
    assert rows[0] == rows[1] and sorted(p for p, _ in rows[0].values()) == list(range(3000))
