import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from txrisk.functions import risk as R
from txrisk.operators import explain
from txrisk.operators.features import engineer_features
from txrisk.plans import models as M
from txrisk.plans.scoring import score_records
from txrisk.schema import FEATURE_COLUMNS, V_COLUMNS
from txrisk.sources import artifacts, tables


@pytest.fixture(scope="module")
def trained(spark):
    tx = tables.transactions(spark, SF001)
    feats, stats = engineer_features(tx)
    feats = feats.cache()
    model = M.fit(M.random_forest(num_trees=10, max_depth=4), feats)
    return tx, feats, stats, model


def test_band_edges_and_decisions(spark):
    ps = [0.0, 0.29949, 0.2995, 0.2996, 0.3, 0.5, 0.6994, 0.6996, 0.7, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    s = R.prob_to_score(F.col("p"))
    rows = df.select("p", s.alias("s"), R.score_to_risk(s).alias("r"), R.decision(F.col("p"), 0.5).alias("d")).collect()
    got = {r["p"]: (r["s"], r["r"], r["d"]) for r in rows}
    assert got[0.2996] == (30.0, "SUSPICIOUS", "REVIEW")  # the rounded score decides the band
    assert got[0.29949] == (29.9, "SAFE", "APPROVE")
    assert got[0.6996] == (70.0, "FRAUD", "BLOCK")
    assert got[0.6994][1] == "SUSPICIOUS" and got[0.6994][2] == "BLOCK"  # p >= threshold blocks
    assert got[0.5][2] == "BLOCK" and got[0.3][2] == "REVIEW" and got[0.0] == (0.0, "SAFE", "APPROVE")
    with pytest.raises(ValueError):
        R.validate_threshold(1.0)
    assert spark.range(1).select(R.clamp_threshold(1.5).alias("t")).first()["t"] == 0.99


def test_model_store_lookup(spark, trained, tmpdir_fresh):
    _, _, _, model = trained
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, "random_forest", f"{tmpdir_fresh}/store")
    artifacts.save_model(spark, model, "random_forest", f"{tmpdir_fresh}/store", version="1")
    p2 = artifacts.save_model(spark, model, "random_forest", f"{tmpdir_fresh}/store", version="2")
    latest = artifacts.manifest(spark, f"{tmpdir_fresh}/store").first()
    assert latest["path"] == p2
    assert artifacts.load_model(spark, "random_forest", f"{tmpdir_fresh}/store") is not None
    with pytest.raises(KeyError):
        artifacts.load_model(spark, "unknown", f"{tmpdir_fresh}/store")


def test_score_records_marks_invalid_rows(spark, trained):
    tx, _, stats, model = trained
    recs = tx.limit(20).drop("Class").withColumn("tx_id", F.format_string("R%d", F.col("id"))).drop("id")
    recs = recs.withColumn("V3", F.when(F.col("tx_id") == F.lit("R0"), F.lit(float("nan"))).otherwise(F.col("V3")))
    out = score_records(model, recs, stats).collect()
    assert len(out) == 20
    bad = [r for r in out if r["error"] is not None]
    assert [r["tx_id"] for r in bad] == ["R0"] and "V3" in bad[0]["error"]
    ok = score_records(model, recs.withColumn("V5", F.lit(None).cast("double")), stats, missing_as_zero=True)
    assert ok.filter(F.col("error").isNotNull()).count() == 1  # only the NaN row; NULL counts as 0


def test_record_scores_do_not_depend_on_partitions(spark, trained):
    tx, _, stats, model = trained
    recs = tx.drop("Class").withColumn("tx_id", F.format_string("R%d", F.col("id"))).drop("id")
    a = {r["tx_id"]: r["fraud_probability"] for r in score_records(model, recs, stats).collect()}
    b = {r["tx_id"]: r["fraud_probability"] for r in score_records(model, recs.repartition(7), stats).collect()}
    assert a == b and len(a) == tx.count()
    named = score_records(model, recs.drop("tx_id").limit(30), stats)
    assert named.filter("tx_id IS NULL").count() == 0 and named.select("tx_id").distinct().count() == 30


def test_importance_table_and_top(spark, trained):
    _, _, _, model = trained
    imp = explain.importance_table(spark, FEATURE_COLUMNS, M.importance_vector(model))
    rows = imp.orderBy("rank").collect()
    assert len(rows) == 38 and [r["rank"] for r in rows] == list(range(1, 39))
    assert abs(sum(r["importance"] for r in rows) - 1.0) < 1e-9
    top = explain.top_features(imp, 20).collect()
    assert len(top) == 20 and top[-1]["rank"] == 1
    assert {r["group"] for r in top} <= {"PCA", "Amount", "Engineered"}


def test_local_explanations_shape_and_determinism(spark, trained):
    _, feats, _, model = trained
    rows = feats.filter("Class = 1").limit(4).select("id", *FEATURE_COLUMNS)
    a = explain.explain_local(model, rows, id_col="id", n_perturbations=100).orderBy("id").collect()
    b = explain.explain_local(model, rows.repartition(3), id_col="id", n_perturbations=100).orderBy("id").collect()
    assert len(a) == 4
    for x, y in zip(a, b):
        assert len(x["top_features"]) == 10
        contrib = [abs(t["contribution"]) for t in x["top_features"]]
        assert contrib == sorted(contrib, reverse=True)
        assert x["top_features"] == y["top_features"]
        lines = x["explanation_text"].split("\n")
        assert lines[0].startswith("Risk Assessment: ") and lines[1] == "" and len(lines) == 8


def test_noise_scale_and_correlation(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    v = df.select(explain.noise_scale(F.col("x")).alias("s")).first()["s"]
    assert v == pytest.approx(((1.25) ** 0.5) * 0.1 + 1e-8)
    z = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert z.agg(explain.correlation(F.col("a"), F.col("b"))).first()[0] == 0.0  # zero variance -> 0, no error


def test_random_search_with_stratified_folds(spark, trained):
    from txrisk.operators import sampling

    _, feats, _, _ = trained
    train = sampling.stratified_folds(feats.select("id", "Class", *FEATURE_COLUMNS), 3)
    grid = {"numTrees": [3, 5], "maxDepth": [2, None], "min_samples_split": [2, 5]}
    maps = M.draw_param_maps(M.random_forest(), grid, 2, seed=1)
    assert len(maps) == 2 and all(len(m) == 2 for m in maps)  # the sklearn-only parameter is dropped
    rf = M.tune(M.random_forest(num_trees=3, max_depth=2), grid, 2, M.f1_of_fraud(), train, parallelism=2)
    gb = M.tune(M.gradient_boosting(max_iter=3, max_depth=2), {"maxIter": [2, 3], "stepSize": [0.1, 0.2]}, 2, M.AveragePrecisionEvaluator(), train)
    for m in (rf, gb):
        assert M.predict(m, feats.limit(5)).count() == 5


def test_search_draws_are_distinct(spark):
    from txrisk.plans import models as M

    for est, grid, n in ((M.random_forest(None), M.RF_GRID, 10), (M.gradient_boosting(), M.GB_GRID, 6)):
        maps = [tuple(sorted((p.name, v) for p, v in m.items())) for m in M.draw_param_maps(est, grid, n)]
        assert len(set(maps)) == n


def test_evaluators_rate_many_models_in_one_pass(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    rows = [(name, i % 3 == 0, ((i * 37 + k * 11) % 10) / 10.0) for k, name in enumerate("abc") for i in range(60)]
    long = spark.createDataFrame([(m, int(y), p, float(p > 0.5)) for m, y, p in rows] + [("none", 0, 0.1, 0.0)], "model string, label int, p double, prediction double")
    f1 = {r.model: r.value for r in M.f1_of_fraud().by_model(long).collect()}
    ap = {r.model: r.value for r in M.AveragePrecisionEvaluator().by_model(long).collect()}
    assert f1.pop("none") == 0.0 and not ap.pop("none")
    own = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0, beta=1.0)
    for name in "abc":
        part = long.filter(F.col("model") == name).withColumn("label", F.col("label").cast("double"))
        assert f1[name] == pytest.approx(own.evaluate(part))
        assert ap[name] == pytest.approx({r.model: r.value for r in M.AveragePrecisionEvaluator().by_model(part).collect()}[name])


def test_a_search_makes_one_evaluation_a_fold(spark, trained):
    from txrisk.operators import sampling

    class Counting(M.AveragePrecisionEvaluator):
        passes = 0

        def by_model(self, pred):
            Counting.passes += 1
            assert pred.select("model").distinct().count() == 3
            return super().by_model(pred)

    _, feats, _, _ = trained
    train = sampling.stratified_folds(feats.select("id", "Class", *FEATURE_COLUMNS), 3)
    grid = {"maxIter": [1, 2, 3]}
    best = M.tune(M.gradient_boosting(max_iter=2, max_depth=2), grid, 3, Counting(), train)
    assert Counting.passes == 3 and best.transform(train.withColumn("label", F.col("Class").cast("double"))).count() == train.count()
