"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric", "value" (sum of query seconds), "unit", "queries", "sf", ...}.
Each query is forced to completion with the no-op sink (full computation, no
collect).  ``BENCH_MODELS=0`` skips the model-training timings.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dataset_stats",
    "dataset_stats_lineitem",
    "fraud_rate_by_hour",
    "hourly_volume_lineitem",
    "amount_histogram_lineitem",
    "amount_boxplot_lineitem",
    "engineered_features",
    "risk_scoring",
    "running_stats",
    "alert_board",
    "model_metrics",
    "roc_points",
    "threshold_sweep",
    "split_counts",
    "undersample_counts",
    "knn_minority_k25",
    "smote_allocation",
    "feature_profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    with_models = os.environ.get("BENCH_MODELS", "1") != "0"
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("txrisk-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from txrisk.catalog import QUERIES
    from txrisk.session import checkpoint_dir

    checkpoint_dir(spark)
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # JVM and file-system warm-up, not timed

    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in HEADLINE:
        t = time.time()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)

    if with_models:
        from pyspark.sql import functions as F

        from txrisk.operators import features, sampling
        from txrisk.plans import models as M
        from txrisk.sources import tables

        tx = tables.transactions(spark, sf_dir)
        split = sampling.with_split(tx)
        st = features.fit_feature_stats(split.filter(F.col("split") == "train"))
        feats, _ = features.engineer_features(split, st)
        path = f"{checkpoint_dir(spark).rstrip('/')}/bench-features-{int(time.time())}"
        feats.write.parquet(path)
        train = spark.read.parquet(path).filter(F.col("split") == "train").cache()
        rows["train_rows"] = train.count()
        t = time.time()
        M.fit(M.gradient_boosting(), train)  # published boosting parameters: 200 trees, depth 5, lr 0.1, subsample 0.8
        times["train_gradient_boosting"] = round(time.time() - t, 3)
        weighted = sampling.with_class_weights(train).cache()
        weighted.count()
        t = time.time()
        M.fit(M.random_forest("weight"), weighted)  # published forest parameters: 200 trees, depth 20, leaf 2, sqrt
        times["train_random_forest"] = round(time.time() - t, 3)

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else sf_dir,
        "cpus": cpus,
        "data_query_seconds": round(sum(v for k, v in times.items() if not k.startswith("train_")), 3),
        "model_fit_seconds": round(sum(v for k, v in times.items() if k.startswith("train_")), 3),
    }
    out.update(rows)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
