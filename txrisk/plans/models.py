"""MLlib classifiers, tuning and batch scoring.

Logistic regression, random forest and gradient-boosted trees train
distributed on the assembled 38-feature vector; tuning draws parameter maps
from the published grids and cross-validates on stratified folds.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.schema import FEATURE_COLUMNS, LABEL

FEATURES = "features"


def assembler(feature_cols: Sequence[str] = FEATURE_COLUMNS) -> VectorAssembler:
    """Ordered feature vector; invalid (null/NaN) values fail the job, as the reference's float matrix would."""
    return VectorAssembler(inputCols=list(feature_cols), outputCol=FEATURES, handleInvalid="error")


def with_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.withColumn("label", F.col(label).cast("double"))


def probability_of_fraud(pred: DataFrame, out: str = "fraud_probability") -> DataFrame:
    """P(class 1) from MLlib's probability vector (0 when a model has none)."""
    if "probability" not in pred.columns:
        return pred.withColumn(out, F.lit(0.0))
    return pred.withColumn(out, vector_to_array("probability")[1])


def logistic_regression(weight_col: str | None = None, C: float = 0.01, max_iter: int = 1000, total_weight: float = 1.0) -> LogisticRegression:
    """L2 logistic regression.  The reference objective C*sum(w*loss) + ||b||^2/2, divided by C*sum(w),
    is MLlib's mean weighted loss + regParam*||b||^2/2 with regParam = 1/(C*sum(w))."""
    lr = LogisticRegression(
        featuresCol=FEATURES,
        labelCol="label",
        maxIter=max_iter,
        regParam=1.0 / (C * total_weight),
        elasticNetParam=0.0,
        standardization=False,
        family="binomial",
    )
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def random_forest(
    weight_col: str | None = None,
    num_trees: int = 200,
    max_depth: int = 20,
    min_instances_per_node: int = 2,
    subset: str = "sqrt",
    seed: int = 42,
    max_memory_mb: int = 2048,
    cache_node_ids: bool = True,
) -> RandomForestClassifier:
    """Deep forests: node ids are cached (and checkpointed with the session's checkpoint folder) so each
    level does not re-route every row from the root; ``max_memory_mb`` bounds the histogram memory per pass."""
    rf = RandomForestClassifier(
        featuresCol=FEATURES,
        labelCol="label",
        numTrees=num_trees,
        maxDepth=min(max_depth, 30),
        minInstancesPerNode=min_instances_per_node,
        featureSubsetStrategy=subset,
        seed=seed,
        maxMemoryInMB=max_memory_mb,
        cacheNodeIds=cache_node_ids,
        checkpointInterval=10,
    )
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf


def gradient_boosting(
    max_iter: int = 200, max_depth: int = 5, step_size: float = 0.1, subsample: float = 0.8, seed: int = 42, weight_col: str | None = None
) -> GBTClassifier:
    """Boosted trees; unweighted by default (the reference computes a positive weight and never uses it)."""
    gb = GBTClassifier(
        featuresCol=FEATURES,
        labelCol="label",
        maxIter=max_iter,
        maxDepth=max_depth,
        stepSize=step_size,
        subsamplingRate=subsample,
        seed=seed,
    )
    if weight_col:
        gb.setWeightCol(weight_col)
    return gb


def fit(estimator, train: DataFrame, feature_cols: Sequence[str] = FEATURE_COLUMNS) -> PipelineModel:
    """Assembler + estimator as one PipelineModel (persisted and reloaded as a unit)."""
    return Pipeline(stages=[assembler(feature_cols), estimator]).fit(with_label(train))


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    out = probability_of_fraud(model.transform(with_label(df) if LABEL in df.columns else df))
    return out.select(*keep, "fraud_probability")


def predictions_long(models: dict[str, PipelineModel], test: DataFrame, id_col: str = "id", label: str = LABEL) -> DataFrame:
    """``model, id, label, p`` for every model on the test rows (input of the metric operators)."""
    parts = []
    for name, m in models.items():
        p = predict(m, test, keep=[id_col, label])
        parts.append(p.select(F.lit(name).alias("model"), F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"), F.col("fraud_probability").alias("p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class ByModelEvaluator(Evaluator):
    """An evaluator that rates many models in one pass over ``model, label, p, prediction`` rows.

    :meth:`by_model` gives ``model, value``; rating one model is the same with one name.
    """

    def by_model(self, pred: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _evaluate(self, dataset: DataFrame) -> float:
        row = self.by_model(rated(dataset, "m")).first()
        return float(row["value"] or 0.0) if row is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True


class AveragePrecisionEvaluator(ByModelEvaluator):
    """Average precision (sum of (R_n - R_{n-1}) * P_n), computed by the exact metric operators."""

    def by_model(self, pred: DataFrame) -> DataFrame:
        from txrisk.operators.metrics import auc_ap

        return auc_ap(pred).select("model", F.col("pr_auc").alias("value"))


class FraudF1Evaluator(ByModelEvaluator):
    """F1 of the fraud class; 0 where there is neither a fraud row nor a prediction of one."""

    def by_model(self, pred: DataFrame) -> DataFrame:
        real, said = F.col("label") == 1, F.col("prediction") == 1
        out = pred.groupBy("model").agg(F.count_if(real & said).alias("tp"), F.count_if(real).alias("real"), F.count_if(said).alias("said"))
        return out.select("model", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("real") + F.col("said")), F.lit(0.0)).alias("value"))


def f1_of_fraud() -> FraudF1Evaluator:
    return FraudF1Evaluator()


def rated(scored: DataFrame, name: str) -> DataFrame:
    """``model, label, p, prediction`` of one model's output."""
    return probability_of_fraud(scored).select(
        F.lit(name).alias("model"), F.col("label").cast("int").alias("label"), F.col("fraud_probability").alias("p"), "prediction"
    )


# Published search spaces (fixed values).
RF_GRID = {
    "numTrees": [100, 200, 300],
    "maxDepth": [10, 20, None],
    "minInstancesPerNode": [1, 2, 4],
    "min_samples_split": [2, 5, 10],
    "featureSubsetStrategy": ["sqrt", "log2"],
}
GB_GRID = {
    "maxIter": [100, 200],
    "maxDepth": [3, 5],
    "stepSize": [0.05, 0.1, 0.2],
    "subsamplingRate": [0.7, 0.8, 1.0],
    "min_samples_split": [5, 10],
}
UNLIMITED_DEPTH = 30  # MLlib's deepest tree stands for "no limit"


def draw_param_maps(estimator, grid: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """At most ``n_iter`` different random points of the grid (parameters without an MLlib counterpart are left out of it)."""
    names = [k for k in grid if estimator.hasParam(k)]
    values = [list(dict.fromkeys(UNLIMITED_DEPTH if k == "maxDepth" and v is None else v for v in grid[k])) for k in names]
    points = list(itertools.product(*values))
    drawn = random.Random(seed).sample(points, min(n_iter, len(points)))
    return [{estimator.getParam(k): v for k, v in zip(names, p, strict=True)} for p in drawn]


def tune(estimator, grid: dict, n_iter: int, evaluator: ByModelEvaluator, train: DataFrame, fold_col: str = "fold", parallelism: int = 4, seed: int = 42,
         feature_cols: Sequence[str] = FEATURE_COLUMNS) -> PipelineModel:
    """Randomised search with stratified folds (``fold_col``); refits the best map (the first of equals) on all rows.

    For each fold all candidates are fitted, ``parallelism`` at a time, and rated together: their predictions on the
    fold are one long table and one pass of the evaluator, so a search costs as many evaluations as there are folds.
    """
    assembled = assembler(feature_cols).transform(with_label(train))
    maps = draw_param_maps(estimator, grid, n_iter, seed)
    total, folds = [0.0] * len(maps), sorted(r[0] for r in assembled.select(fold_col).distinct().collect())
    for fold in folds:
        own = assembled.filter(F.col(fold_col) != fold).cache()
        fits = estimator.fitMultiple(own, maps)
        with ThreadPool(min(parallelism, len(maps))) as pool:
            models = dict(pool.map(inheritable_thread_target(train.sparkSession)(lambda _: next(fits)), range(len(maps))))
        held = assembled.filter(F.col(fold_col) == fold)
        long = reduce(DataFrame.unionByName, [rated(models[i].transform(held), str(i)) for i in range(len(maps))])
        for r in evaluator.by_model(long).collect():  # one row a candidate
            total[int(r["model"])] += float(r["value"] or 0.0) / len(folds)
        own.unpersist()
    best = max(range(len(maps)), key=lambda i: (total[i] if evaluator.isLargerBetter() else -total[i], -i))
    return PipelineModel(stages=[assembler(feature_cols), estimator.copy(maps[best]).fit(assembled)])


def importance_vector(model: PipelineModel) -> list[float]:
    """Tree importances, or |coefficients| for a linear model."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        return [float(x) for x in last.featureImportances.toArray()]
    if hasattr(last, "coefficients"):
        return [abs(float(x)) for x in last.coefficients.toArray()]
    raise ValueError(f"{type(last).__name__} has neither importances nor coefficients")
