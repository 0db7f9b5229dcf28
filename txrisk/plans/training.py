"""End-to-end training job: ingest -> profile -> features -> split -> rebalance -> train -> evaluate -> artefacts.

Usage (spark-submit or python)::

    python -m txrisk.plans.training --input <csv or sf dir> --out <shared dir> [--strategy weighted|smote|undersample] [--tune]
"""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.operators import cleaning, eda, explain, features, metrics, sampling
from txrisk.operators.stats import dataset_stats, dataset_stats_record
from txrisk.plans import models as M
from txrisk.schema import FEATURE_COLUMNS
from txrisk.sources import artifacts


@dataclass
class TrainingConfig:
    strategy: str = "weighted"  # weighted | smote | undersample
    tune: bool = False
    test_size: float = 0.2
    seed: int = 42
    undersample_ratio: float = 10.0
    smote_k: int = 5
    threshold: float = 0.5
    fit_on: str = "train"  # statistics fitted on the training rows ('all' reproduces the published leakage)
    lr: dict = field(default_factory=lambda: {"C": 0.01, "max_iter": 1000})
    rf: dict = field(default_factory=lambda: {"num_trees": 200, "max_depth": 20, "min_instances_per_node": 2})
    gb: dict = field(default_factory=lambda: {"max_iter": 200, "max_depth": 5, "step_size": 0.1, "subsample": 0.8})
    gb_cap: bool = False  # optional boosting sample cap (all fraud + <= 50k legit above 100k rows)
    models: tuple = ("logistic_regression", "random_forest", "gradient_boosting")


DISPLAY = {"logistic_regression": "Logistic Regression", "random_forest": "Random Forest", "gradient_boosting": "Gradient Boosting"}


def run_training(spark: SparkSession, data: DataFrame, out_dir: str, cfg: TrainingConfig | None = None) -> dict:
    cfg = cfg or TrainingConfig()
    t0 = time.time()
    out = out_dir.rstrip("/")
    clean = cleaning.clean(data).cache()

    # profile + EDA tables
    stats_df = dataset_stats(clean)
    artifacts.write_json(dataset_stats_record(stats_df), f"{out}/dataset_stats")
    eda.class_counts(clean).write.mode("overwrite").parquet(f"{out}/eda/class_counts")
    eda.hourly_volume(clean).write.mode("overwrite").parquet(f"{out}/eda/hourly_volume")
    eda.fraud_rate_by_hour(clean).write.mode("overwrite").parquet(f"{out}/eda/fraud_rate_by_hour")
    eda.amount_histogram(clean).write.mode("overwrite").parquet(f"{out}/eda/amount_histogram")
    eda.amount_boxplot(clean).write.mode("overwrite").parquet(f"{out}/eda/amount_boxplot")

    # split, then statistics and features
    split = sampling.with_split(clean, test_size=cfg.test_size, seed=cfg.seed)
    fit_rows = split.filter(F.col("split") == "train") if cfg.fit_on == "train" else split
    stats = features.fit_feature_stats(fit_rows)
    feats, _ = features.engineer_features(split, stats)
    # a written table cuts the lineage of positions/windows before the model loops
    feats.write.mode("overwrite").parquet(f"{out}/features")
    feats = spark.read.parquet(f"{out}/features")
    train = feats.filter(F.col("split") == "train").drop("split")
    test = feats.filter(F.col("split") == "test").drop("split")

    if cfg.strategy == "smote":
        train = sampling.smote(train, FEATURE_COLUMNS, k_neighbors=cfg.smote_k, seed=cfg.seed).drop("is_synthetic", "base_id")
    elif cfg.strategy == "undersample":
        train = sampling.random_undersample(train, ratio=cfg.undersample_ratio, seed=cfg.seed)
    elif cfg.strategy != "weighted":
        raise ValueError(f"unknown strategy {cfg.strategy}")
    # linear model and forest are class-weighted under every strategy: explicit weights of the training
    # set ("weighted") or balanced weights, which are the same formula n / (k * n_c) on the final rows;
    # boosting stays unweighted
    weight_col = "weight"
    train = sampling.with_class_weights(train, weight_col=weight_col)
    train.select("id", "Class", *FEATURE_COLUMNS, weight_col).write.mode("overwrite").parquet(f"{out}/train")
    train = spark.read.parquet(f"{out}/train").cache()
    if cfg.tune:
        train = sampling.stratified_folds(train, 3, seed=cfg.seed)

    total_w = train.agg(F.sum(weight_col)).first()[0]
    fitted = {}
    store = f"{out}/models"
    for name in cfg.models:
        if name == "logistic_regression":
            m = M.fit(M.logistic_regression(weight_col, total_weight=total_w, **cfg.lr), train)
        elif name == "random_forest":
            if cfg.tune:
                m = M.tune(M.random_forest(weight_col, seed=cfg.seed), M.RF_GRID, 10, M.f1_of_fraud(), train, seed=cfg.seed)
            else:
                m = M.fit(M.random_forest(weight_col, seed=cfg.seed, **cfg.rf), train)
        elif name == "gradient_boosting":
            gtrain = sampling.cap_majority(train, seed=cfg.seed) if cfg.gb_cap else train
            if cfg.tune:
                m = M.tune(M.gradient_boosting(seed=cfg.seed), M.GB_GRID, 6, M.AveragePrecisionEvaluator(), gtrain.drop(weight_col), seed=cfg.seed)
            else:
                m = M.fit(M.gradient_boosting(seed=cfg.seed, **cfg.gb), gtrain.drop(weight_col))
        else:
            raise ValueError(name)
        artifacts.save_model(spark, m, name, store)
        fitted[DISPLAY[name]] = m

    preds = M.predictions_long(fitted, test)
    preds.write.mode("overwrite").parquet(f"{out}/predictions")
    preds = spark.read.parquet(f"{out}/predictions")
    met = metrics.evaluate(preds, cfg.threshold)
    order = {n: i for i, n in enumerate(fitted)}
    pos = F.create_map(*[x for n, i in order.items() for x in (F.lit(n), F.lit(i))])
    met = met.withColumn("position", pos[F.col("model_name")])
    artifacts.write_json(metrics.metrics_record(met.drop("position")), f"{out}/model_metrics")
    metrics.roc_points(preds).write.mode("overwrite").parquet(f"{out}/roc_points")
    metrics.pr_points(preds).write.mode("overwrite").parquet(f"{out}/pr_points")
    metrics.threshold_sweep(preds).write.mode("overwrite").parquet(f"{out}/threshold_sweep")
    best = metrics.best_by_recall(met).first()

    imp_model = fitted.get("Gradient Boosting") or next(iter(fitted.values()))
    imp = explain.importance_table(spark, FEATURE_COLUMNS, M.importance_vector(imp_model))
    artifacts.write_csv(imp.orderBy("rank"), f"{out}/feature_importance")
    artifacts.write_text(spark, stats.to_json(), f"{out}/feature_stats")
    clean.unpersist()
    train.unpersist()
    return {"best_by_recall": best["model_name"], "recall": best["recall"], "seconds": round(time.time() - t0, 1), "models": list(fitted)}


def main(argv=None):
    ap = argparse.ArgumentParser(description="Train the fraud models")
    ap.add_argument("--input", required=True, help="CSV file/folder, or a folder of driver parquet tables")
    ap.add_argument("--out", required=True)
    ap.add_argument("--strategy", choices=["smote", "undersample", "weighted"], default="weighted")
    ap.add_argument("--tune", action="store_true")
    a = ap.parse_args(argv)
    from txrisk.session import get_spark
    from txrisk.sources import ingest, tables

    spark = get_spark()
    if artifacts._exists(spark, f"{a.input.rstrip('/')}/events.parquet"):
        data = tables.transactions(spark, a.input)  # a folder of the driver tables
    else:
        data = ingest.read_transactions_csv(spark, a.input)  # CSV file, folder or glob
    print(json.dumps(run_training(spark, data, a.out, TrainingConfig(strategy=a.strategy, tune=a.tune))))


if __name__ == "__main__":
    main()
