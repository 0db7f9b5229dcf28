"""Artefact sinks and sources: stats/metrics JSON, importance CSV, model store, prediction log."""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.schema import PREDICTION_LOG_SCHEMA

ARRAY_COLUMNS = ("y_prob", "y_test", "roc_curve", "pr_curve")

STATS_SCHEMA = T.StructType(
    [
        T.StructField("total_transactions", T.LongType()),
        T.StructField("fraud_count", T.LongType()),
        T.StructField("legitimate_count", T.LongType()),
        T.StructField("fraud_rate_pct", T.DoubleType()),
        T.StructField("imbalance_ratio", T.DoubleType()),
        T.StructField(
            "amount_stats",
            T.StructType([T.StructField(n, T.DoubleType()) for n in ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]]),
        ),
        T.StructField("time_range_hours", T.DoubleType()),
    ]
)

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("pr_auc", T.DoubleType()),
        T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("tn", T.LongType()),
        T.StructField("fp", T.LongType()),
        T.StructField("fn", T.LongType()),
        T.StructField("tp", T.LongType()),
        T.StructField("evaluated_at", T.StringType()),
    ]
)

IMPORTANCE_SCHEMA = "feature string, importance double, importance_pct double, rank int"
MANIFEST_SCHEMA = "model_name string, version string, path string, saved_at string"


def write_json(df: DataFrame, path: str, drop: tuple = ARRAY_COLUMNS) -> None:
    """JSON sink (overwrite); bulky array columns of metric records are left out."""
    df.drop(*[c for c in drop if c in df.columns]).coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One-line text artefact (e.g. fitted feature statistics) on any Hadoop file system."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).first()["value"]


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IMPORTANCE_SCHEMA).option("header", True).csv(path)


# ---------------------------------------------------------------------------
# model store
# ---------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _create_only(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless one of that name is there; False if it is.  On HDFS one of two racing callers wins."""
    fs, p = _hadoop(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def save_model(spark: SparkSession, model, model_name: str, store: str, version: str | None = None) -> str:
    """Save a version and enter it in the manifest; the entry with the highest number is the latest.

    The model is written under a name of its own first.  An entry ``store/manifest/<name>/<number>`` is created, never
    replaced: of two savers at once one takes the next number and the other the one after it, so both versions are
    kept and one of them is the latest.  An explicit ``version`` may be saved again; the later entry counts.
    """
    now = _dt.datetime.now()
    version = version or now.strftime("%Y%m%d_%H%M%S_%f")
    base = store.rstrip("/")
    path = f"{base}/{model_name}_v{version}-{uuid.uuid4().hex[:8]}"
    model.write().save(path)
    entry = {"model_name": model_name, "version": version, "path": path, "saved_at": now.isoformat()}
    folder = f"{base}/manifest/{model_name}"
    while True:
        taken = listed(spark, folder, "entry-")
        number = int(taken[-1]) + 1 if taken else 0
        if _create_only(spark, f"{folder}/entry-{number:010d}", json.dumps(entry | {"number": number}) + "\n"):
            return path


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """Latest entry per model name."""
    path = f"{store.rstrip('/')}/manifest"
    if not _exists(spark, path):
        raise FileNotFoundError(f"the model store {store} has no manifest")
    m = spark.read.schema(f"{MANIFEST_SCHEMA}, number long").option("recursiveFileLookup", True).json(path).filter(F.col("path").isNotNull())
    latest = F.max_by(F.struct("version", "path", "saved_at"), "number")  # an entry still being written has no fields yet
    return m.groupBy("model_name").agg(latest.alias("_l")).select("model_name", "_l.version", "_l.path", "_l.saved_at")


def load_model(spark: SparkSession, model_name: str, store: str):
    from pyspark.ml import PipelineModel

    rows = manifest(spark, store).filter(F.col("model_name") == model_name).collect()
    if not rows:
        raise KeyError(f"no saved version of {model_name} in {store}")
    return PipelineModel.load(rows[0]["path"])


# ---------------------------------------------------------------------------
# prediction log
#
# Rows lie under log_dir/log_date=<day>/batch_id=<n>-<attempt>; an attempt counts once its batch's commit record
# <log_dir>_commits/log_date=<day>/batch_id=<n> names it.  The record is one small file, put in place by a rename, so a
# reader sees a batch's old attempt or its new one, never none or half.  Replaced attempts stay until their day is removed.
# The records lie beside the log, so that patterns over its folders find rows only.
# ---------------------------------------------------------------------------

_COMMIT_SCHEMA = "batch_id string, attempt string"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names of a folder's entries; a listing only, no file is read."""
    fs, p = _hadoop(spark, folder)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears whole, replacing an earlier one in one step."""
    jvm = spark.sparkContext._jvm
    fs, target = _hadoop(spark, path)
    fs.mkdirs(target.getParent())
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_new-{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, target, options)


def write_log_batch(rows: DataFrame, log_dir: str, day: str, batch_id: int) -> str:
    """Write a batch's rows under a new attempt name, then commit the attempt; returns its name."""
    attempt = f"{batch_id}-a{uuid.uuid4().hex}"
    base = log_dir.rstrip("/")
    rows.select(*[f.name for f in PREDICTION_LOG_SCHEMA.fields]).write.json(f"{base}/log_date={day}/batch_id={attempt}")
    put_file(rows.sparkSession, f"{base}_commits/log_date={day}/batch_id={batch_id}", json.dumps({"batch_id": str(batch_id), "attempt": attempt}) + "\n")
    return attempt


def last_log_day(spark: SparkSession, log_dir: str) -> str | None:
    """The last day with a committed batch (in a log without commit records, the last day): from names of folders only."""
    base = log_dir.rstrip("/")
    days = listed(spark, f"{base}_commits", "log_date=") if _exists(spark, f"{base}_commits") else listed(spark, base, "log_date=")
    return days[-1] if days else None


def read_log(spark: SparkSession, log_dir: str, day: str | None = None) -> DataFrame:
    """Committed prediction-log records, of one day if asked (malformed lines dropped); no log -> empty frame with the schema.

    A folder without commit records is read as it stands.
    """
    schema = T.StructType(PREDICTION_LOG_SCHEMA.fields + [T.StructField("log_date", T.StringType())])
    base = log_dir.rstrip("/")
    if not _exists(spark, base):
        return spark.createDataFrame([], schema)
    commits = None
    if _exists(spark, f"{base}_commits"):  # listed before the rows, so the rows of every record are there
        days = listed(spark, f"{base}_commits", "log_date=")
        paths = [f"{base}_commits/log_date={d}" for d in days if day in (None, d)]
        if not paths:
            return spark.createDataFrame([], schema)
        commits = spark.read.schema(_COMMIT_SCHEMA).option("recursiveFileLookup", True).json(paths)
    df = spark.read.schema(PREDICTION_LOG_SCHEMA).option("mode", "DROPMALFORMED").option("basePath", base).json(base)
    if "log_date" not in df.columns:
        df = df.withColumn("log_date", F.lit(None).cast("string"))
    if day is not None:
        kind = dict(df.dtypes)["log_date"]  # found in the folder names: a date, as a rule
        df = df.filter(F.col("log_date") == F.lit(day).cast(kind))
    if commits is not None:
        held = commits.select(F.col("attempt").alias("_attempt"))
        df = df.join(held, F.col("batch_id").cast("string") == F.col("_attempt"), "left_semi")
    df = df.withColumn("log_date", F.col("log_date").cast("string"))
    # a line that parses but has no fields is not a record
    return df.filter(F.col("tx_id").isNotNull() | F.col("risk_level").isNotNull()).select(*[f.name for f in schema.fields])


def read_latest_log(spark: SparkSession, log_dir: str) -> DataFrame:
    """Records of the most recent log day only (the alert board's input); files of other days are not read."""
    last = last_log_day(spark, log_dir)
    return read_log(spark, log_dir, last) if last is not None else read_log(spark, log_dir).limit(0)
