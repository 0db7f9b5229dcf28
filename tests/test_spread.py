"""Wide rows are dealt over tasks by their number, and the results do not change with it."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from txrisk.operators import explain, features, ordering
from txrisk.plans import models as M
from txrisk.schema import FEATURE_COLUMNS
from txrisk.sources import tables
from txrisk.streaming.scorer import StreamScorer


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture()
def small_tasks(monkeypatch):
    monkeypatch.setattr(ordering, "TASK_ROWS", 60)


def _tasks(df):
    df.count()
    return df.rdd.getNumPartitions()


def test_features_are_spread_by_rows(spark, monkeypatch):
    tx = tables.transactions(spark, SF001)
    stats = features.fit_feature_stats(tx)
    plain = _rows(features.engineer_features(tx, stats)[0])
    monkeypatch.setattr(ordering, "TASK_ROWS", 60)
    out, _ = features.engineer_features(tx, stats)
    assert _rows(out) == plain
    assert _tasks(out) >= ordering.task_count(tx.count()) > 8


def test_content_ids_and_joined_positions_are_spread_by_rows(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 400).alias("a"), F.lit("x").alias("b")).repartition(3)
    keyed = spark.range(1000).select("id", (F.col("id") * 7 % 13).cast("double").alias("t"))
    ids, pos = (_rows(ordering.with_content_ids(df)), _rows(ordering.attach_positions(keyed, ["t", "id"])))
    monkeypatch.setattr(ordering, "TASK_ROWS", 60)
    out, places = ordering.with_content_ids(df), ordering.attach_positions(keyed, ["t", "id"])
    assert _rows(out) == ids and _rows(places) == pos
    assert _tasks(out) >= 17 and _tasks(places) >= 17


def test_wide_blocks_are_spread_by_rows(spark, small_tasks):
    pos = spark.range(3000).select("id", F.col("id").alias("_pos"), (F.col("id") % 7).cast("double").alias("v"))
    plain = ordering.rolling_over_positions(pos, {"m": F.avg("v")}, 20, block_rows=100)
    dealt = ordering.rolling_over_positions(pos, {"m": F.avg("v")}, 20, block_rows=100, n=3000)
    assert _rows(dealt) == _rows(plain) and _tasks(dealt) >= 50
    assert StreamScorer(spark, None, None, "log", "state").block_rows <= 100_000


def test_scans_have_tasks_by_rows_while_training(spark, small_tasks, tmpdir_fresh):
    spark.range(3000).repartition(100).write.parquet(f"{tmpdir_fresh}/t")
    key = "spark.sql.files.minPartitionNum"
    before, packed = spark.conf.get(key, None), spark.read.parquet(f"{tmpdir_fresh}/t").rdd.getNumPartitions()
    with ordering.scans_by_rows(spark, 3000):
        assert spark.read.parquet(f"{tmpdir_fresh}/t").rdd.getNumPartitions() > packed
    assert spark.conf.get(key, None) == before


def test_explanations_do_not_sort_the_draws(spark):
    feats, _ = features.engineer_features(tables.transactions(spark, SF001))
    model = M.fit(M.gradient_boosting(max_iter=2, max_depth=2), feats)
    out = explain.explain_local(model, feats.limit(3).select("id", *FEATURE_COLUMNS), id_col="id", n_perturbations=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert out.count() == 3
