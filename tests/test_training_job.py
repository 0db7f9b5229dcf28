import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from txrisk.operators import sampling
from txrisk.plans.training import TrainingConfig, run_training
from txrisk.sources import artifacts, tables

SMALL = dict(
    lr={"C": 0.01, "max_iter": 30},
    rf={"num_trees": 5, "max_depth": 4, "min_instances_per_node": 2},
    gb={"max_iter": 3, "max_depth": 3, "step_size": 0.1, "subsample": 0.8},
)


@pytest.mark.parametrize("strategy", ["weighted", "undersample"])
def test_training_job_writes_all_artefacts(spark, tmpdir_fresh, strategy):
    out = f"{tmpdir_fresh}/run"
    res = run_training(spark, tables.transactions(spark, SF001), out, TrainingConfig(strategy=strategy, **SMALL))
    assert set(res["models"]) == {"Logistic Regression", "Random Forest", "Gradient Boosting"}
    met = artifacts.read_metrics(spark, f"{out}/model_metrics").collect()
    assert len(met) == 3
    n_test = sum(sampling.split_sizes(sampling.class_counts_map(tables.transactions(spark, SF001)), 0.2).values())
    for m in met:
        assert m["tn"] + m["fp"] + m["fn"] + m["tp"] == n_test
        assert m["confusion_matrix"] == [[m["tn"], m["fp"]], [m["fn"], m["tp"]]]
    stats = artifacts.read_stats(spark, f"{out}/dataset_stats").first()
    assert stats["total_transactions"] == 1000 and stats["amount_stats"]["count"] == 1000.0
    imp = artifacts.read_importance(spark, f"{out}/feature_importance")
    assert imp.count() == 38 and imp.agg(F.min("rank"), F.max("rank")).first() == (1, 38)
    assert artifacts.manifest(spark, f"{out}/models").count() == 3
    assert spark.read.parquet(f"{out}/threshold_sweep").count() == 3 * 99
    assert res["best_by_recall"] in res["models"]


def test_unknown_strategy(spark, tmpdir_fresh):
    with pytest.raises(ValueError):
        run_training(spark, tables.transactions(spark, SF001), f"{tmpdir_fresh}/x", TrainingConfig(strategy="nope", **SMALL))


def test_shuffled_is_a_permutation(spark):
    tx = tables.transactions(spark, SF001)
    a = [r["id"] for r in sampling.shuffled(tx).select("id").collect()]
    b = [r["id"] for r in sampling.shuffled(tx.repartition(4)).select("id").collect()]
    assert a == b and sorted(a) == sorted(r["id"] for r in tx.select("id").collect()) and a != sorted(a)
