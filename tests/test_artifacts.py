import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from txrisk.operators import explain, metrics
from txrisk.operators.stats import dataset_stats, dataset_stats_record
from txrisk.schema import FEATURE_COLUMNS
from txrisk.sources import artifacts, tables


def test_stats_json_round_trip(spark, tmpdir_fresh):
    rec = dataset_stats_record(dataset_stats(tables.transactions(spark, SF001)))
    artifacts.write_json(rec, f"{tmpdir_fresh}/stats")
    back = artifacts.read_stats(spark, f"{tmpdir_fresh}/stats").first().asDict(recursive=True)
    want = rec.first().asDict(recursive=True)
    assert back == want
    assert set(back["amount_stats"]) == {"count", "mean", "std", "min", "25%", "50%", "75%", "max"}


def test_metrics_json_drops_curve_arrays(spark, tmpdir_fresh):
    pred = tables.predictions(spark, SF001)
    rec = metrics.metrics_record(metrics.evaluate(pred)).withColumn("roc_curve", F.array(F.lit(1.0))).withColumn("y_prob", F.array(F.lit(0.5)))
    artifacts.write_json(rec, f"{tmpdir_fresh}/metrics")
    raw = spark.read.json(f"{tmpdir_fresh}/metrics")
    assert "roc_curve" not in raw.columns and "y_prob" not in raw.columns
    back = {r["model_name"]: r for r in artifacts.read_metrics(spark, f"{tmpdir_fresh}/metrics").collect()}
    assert set(back) == {"m1", "m2"}
    for r in back.values():
        assert r["confusion_matrix"] == [[r["tn"], r["fp"]], [r["fn"], r["tp"]]] and r["evaluated_at"]


def test_importance_csv_round_trip(spark, tmpdir_fresh):
    imp = explain.importance_table(spark, FEATURE_COLUMNS, [float(i + 1) for i in range(38)])
    artifacts.write_csv(imp.orderBy("rank"), f"{tmpdir_fresh}/imp")
    back = {r["feature"]: r for r in artifacts.read_importance(spark, f"{tmpdir_fresh}/imp").collect()}
    assert len(back) == 38 and back["V4_V11_interaction"]["rank"] == 1
    assert back["V1"]["importance"] == pytest.approx(1 / sum(range(1, 39)))
    assert back["V4_V11_interaction"]["importance_pct"] == round(38 / sum(range(1, 39)) * 100, 2)


def test_text_artifact(spark, tmpdir_fresh):
    artifacts.write_text(spark, '{"a": 1}', f"{tmpdir_fresh}/t")
    assert artifacts.read_text(spark, f"{tmpdir_fresh}/t") == '{"a": 1}'


def test_two_savers_leave_two_versions_and_one_latest(spark, tmpdir_fresh):
    import threading

    from pyspark.ml import PipelineModel

    store = f"{tmpdir_fresh}/store"
    model = PipelineModel(stages=[])
    real = artifacts.listed

    def both_see_the_same(*args):  # each saver lists the manifest before the other has entered its version
        out = real(*args)
        if not out and not gate.broken:
            try:
                gate.wait(20)
            except threading.BrokenBarrierError:
                pass
        return out

    gate = threading.Barrier(2)
    order: list[str] = []
    lock = threading.Lock()
    create = artifacts._create_only

    def one_at_a_time(*args):
        with lock:
            return create(*args)

    artifacts.listed, artifacts._create_only = both_see_the_same, one_at_a_time
    try:
        threads = [threading.Thread(target=lambda v=v: order.append(artifacts.save_model(spark, model, "m", store, version=v))) for v in ("1", "2")]
        [t.start() for t in threads]
        [t.join(120) for t in threads]
    finally:
        artifacts.listed, artifacts._create_only = real, create
    entries = spark.read.option("recursiveFileLookup", True).json(f"{store}/manifest").collect()
    assert sorted(r["version"] for r in entries) == ["1", "2"] and sorted(r["number"] for r in entries) == [0, 1]
    latest = artifacts.manifest(spark, store).collect()
    assert [r["version"] for r in latest] == [max(entries, key=lambda r: r["number"])["version"]]
    assert len(set(order)) == 2 and artifacts.load_model(spark, "m", store) is not None
    with pytest.raises(KeyError):
        artifacts.load_model(spark, "other", store)
