"""Structured Streaming scorer: transactions as they arrive -> features -> model -> risk -> dated log.

Each micro-batch (``foreachBatch``):

* re-reads the decision threshold from a small control table, so it can be
  changed while the query runs (clamped to [0.01, 0.99]);
* numbers its rows after all earlier ones (``TX_%06d`` in arrival order,
  (Time, id) inside a batch) using the row total carried from the previous
  batch;
* computes the 100-row rolling features over (last 99 rows of earlier
  batches) ∪ (this batch) with the block/halo plan, and the per-row features
  from the frozen training statistics;
* scores with the model and writes the log rows (without the alert struct)
  under a new attempt name, then commits the attempt: a replayed batch replaces
  its earlier attempt instead of duplicating it, and a reader meanwhile sees the
  one or the other; the day is stored with the batch id, so this holds for a
  replay after midnight too;
* fails if the state of the batch before is missing or was not written to its end;
* stores its tail (99 rows + row total) and the running totals under
  ``state_dir/.../batch_id=<n>``, keyed by batch id for the same reason.

Running totals are constant-size: one row merged per batch.  The same totals
as a pure streaming aggregation over a log folder are in :func:`running_totals_stream`;
with the last predictions, on the state store, in :mod:`txrisk.streaming.running`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions import risk as R
from txrisk.operators.features import row_features
from txrisk.operators.ordering import TASK_ROWS, rolling_over_positions, with_positions
from txrisk.operators.stats import FeatureStats
from txrisk.plans.models import probability_of_fraud
from txrisk.schema import DEFAULT_THRESHOLD, RISK_LEVELS, ROLLING_ROWS
from txrisk.sources.artifacts import _exists, listed, write_log_batch

TOTALS_SCHEMA = "total_processed long, fraud_detected long, score_sum double, n_safe long, n_suspicious long, n_fraud long"


class StreamScorer:
    def __init__(
        self,
        spark: SparkSession,
        model,
        stats: FeatureStats,
        log_dir: str,
        state_dir: str,
        threshold_path: str | None = None,
        default_threshold: float = DEFAULT_THRESHOLD,
        rows: int = ROLLING_ROWS,
        block_rows: int = TASK_ROWS // 4,
    ):
        self.spark = spark
        self.model = model
        self.stats = stats
        self.log_dir = log_dir.rstrip("/")
        self.state_dir = state_dir.rstrip("/")
        self.threshold_path = threshold_path
        self.default_threshold = default_threshold
        self.rows = rows
        self.block_rows = block_rows

    # -- control and state ---------------------------------------------------
    def set_threshold(self, threshold: float) -> float:
        """Store a new threshold (clamped); the next micro-batch picks it up."""
        t = max(0.01, min(0.99, float(threshold)))
        if self.threshold_path:
            self.spark.createDataFrame([(t,)], "threshold double").coalesce(1).write.mode("overwrite").json(self.threshold_path)
        else:
            self.default_threshold = t
        return t

    def current_threshold(self) -> float:
        if self.threshold_path and _exists(self.spark, self.threshold_path):
            row = self.spark.read.schema("threshold double").json(self.threshold_path).first()
            if row is not None and row["threshold"] is not None:
                return max(0.01, min(0.99, float(row["threshold"])))
        return max(0.01, min(0.99, float(self.default_threshold)))

    def _state(self, kind: str, batch_id: int) -> str:
        return f"{self.state_dir}/{kind}/batch_id={batch_id}"

    def _read_state(self, kind: str, batch_id: int, schema: str) -> DataFrame | None:
        path = self._state(kind, batch_id)
        return self.spark.read.schema(schema).parquet(path) if _exists(self.spark, f"{path}/_SUCCESS") else None

    def _batch_day(self, batch_id: int) -> str:
        """The log day of a batch, stored before its first write, so that a replay on a later day rewrites the same folder."""
        stored = self._read_state("day", batch_id, "day string")
        row = stored.first() if stored is not None else None
        if row is not None:
            return row["day"]
        today = self.spark.range(1).select(F.date_format(F.current_date(), "yyyy-MM-dd").alias("day"))
        day = today.first()[0]
        self.spark.createDataFrame([(day,)], "day string").coalesce(1).write.mode("overwrite").parquet(self._state("day", batch_id))
        return day

    # -- one micro-batch ------------------------------------------------------
    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = self.spark
        threshold = self.current_threshold()
        tail = self._read_state("tail", batch_id - 1, "id long, Time double, Amount double, _pos long")
        totals = self._read_state("totals", batch_id - 1, TOTALS_SCHEMA)
        if batch_id > 0 and (tail is None or totals is None):
            raise RuntimeError(f"no stored state of batch {batch_id - 1} under {self.state_dir}; numbering and totals cannot be carried on")
        seen = tail.agg(F.max("_pos")).first()[0] if tail is not None else None
        offset = 0 if seen is None else seen + 1

        batch = batch.persist()
        pos = with_positions(batch, ["Time", "id"], pos_col="_pos").withColumn("_pos", F.col("_pos") + F.lit(offset))
        both = pos.withColumn("_carry", F.lit(False))
        if tail is not None:
            both = both.unionByName(tail.withColumn("_carry", F.lit(True)), allowMissingColumns=True)
        n = pos.count()  # of the written positions
        rolled = rolling_over_positions(both, {"rolling_avg_amount": F.avg("Amount")}, self.rows, block_rows=self.block_rows, n=n)
        rolled = rolled.filter(~F.col("_carry")).drop("_carry")
        feats = row_features(rolled, self.stats).withColumns(
            {
                "tx_velocity": F.least(F.col("_pos") + 1, F.lit(self.rows)).cast("double"),
                "amount_deviation": F.abs(F.col("Amount") - F.col("rolling_avg_amount")),
            }
        )
        scored = probability_of_fraud(self.model.transform(feats))
        s = R.prob_to_score(F.col("fraud_probability"))
        log = scored.select(
            F.format_string("TX_%06d", F.col("_pos") + 1).alias("tx_id"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            "fraud_probability",
            s.alias("fraud_score"),
            R.score_to_risk(s).alias("risk_level"),
            R.decision(F.col("fraud_probability"), threshold).alias("decision"),
            F.lit(threshold).alias("threshold_used"),
            "_pos",
            "id",
            "Time",
            "Amount",
        ).persist()
        day = self._batch_day(batch_id)
        write_log_batch(log, self.log_dir, day, batch_id)

        # state for the next batch: last rows-1 positions and merged totals (both keyed by this batch id)
        keep_from = log.agg(F.max("_pos")).first()[0]
        if keep_from is None:  # empty batch: hand the previous tail on
            new_tail = tail if tail is not None else spark.createDataFrame([], "id long, Time double, Amount double, _pos long")
        else:
            fresh = log.filter(F.col("_pos") > F.lit(keep_from - (self.rows - 1))).select("id", "Time", "Amount", "_pos")
            new_tail = fresh if tail is None else fresh.unionByName(tail).filter(F.col("_pos") > F.lit(keep_from - (self.rows - 1)))
        new_tail.write.mode("overwrite").parquet(self._state("tail", batch_id))

        agg = log.agg(
            F.count(F.lit(1)).alias("total_processed"),
            F.count_if(F.col("risk_level") == "FRAUD").alias("fraud_detected"),
            F.coalesce(F.sum("fraud_score"), F.lit(0.0)).alias("score_sum"),
            *[F.count_if(F.col("risk_level") == lvl).alias(f"n_{lvl.lower()}") for lvl in RISK_LEVELS],
        )
        if totals is not None:
            agg = agg.unionByName(totals).agg(*[F.sum(c).alias(c) for c in agg.columns])
        agg.coalesce(1).write.mode("overwrite").parquet(self._state("totals", batch_id))
        log.unpersist()
        batch.unpersist()

    # -- driver side -----------------------------------------------------------
    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None, query_name: str | None = None):
        w = stream.writeStream.foreachBatch(self.process_batch).option("checkpointLocation", checkpoint)
        if query_name:
            w = w.queryName(query_name)
        w = w.trigger(**(trigger or {"availableNow": True}))
        return w.start()

    def dashboard_stats(self, batch_id: int | None = None) -> DataFrame:
        """Running totals after ``batch_id`` (default: the latest stored)."""
        if batch_id is None:
            base = f"{self.state_dir}/totals"
            ids = sorted((int(i) for i in listed(self.spark, base, "batch_id=")), reverse=True)
            batch_id = next((i for i in ids if _exists(self.spark, f"{base}/batch_id={i}/_SUCCESS")), None)
            if batch_id is None:
                return finish_totals(self.spark.createDataFrame([(0, 0, 0.0, 0, 0, 0)], TOTALS_SCHEMA), self.current_threshold())
        t = self._read_state("totals", batch_id, TOTALS_SCHEMA)
        return finish_totals(t, self.current_threshold())


def finish_totals(t: DataFrame, threshold: float) -> DataFrame:
    n = F.col("total_processed")
    return t.select(
        "total_processed",
        "fraud_detected",
        F.coalesce(F.try_divide(F.col("score_sum"), n), F.lit(0.0)).alias("avg_score"),
        F.create_map(*[x for lvl in RISK_LEVELS for x in (F.lit(lvl), F.col(f"n_{lvl.lower()}"))]).alias("alert_distribution"),
        F.round(F.col("fraud_detected") / F.greatest(n, F.lit(1)) * 100.0, 2).alias("fraud_rate_pct"),
        F.lit(float(threshold)).alias("current_threshold"),
    )


def read_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """File source over a folder of arriving transaction files."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(source_dir)


def running_totals_stream(log_stream: DataFrame) -> DataFrame:
    """Unbounded global aggregation over a streaming log (complete output mode; state is one row)."""
    return log_stream.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(F.col("risk_level") == "FRAUD").alias("fraud_detected"),
        F.avg("fraud_score").alias("avg_score"),
        *[F.count_if(F.col("risk_level") == lvl).alias(f"n_{lvl.lower()}") for lvl in RISK_LEVELS],
    )
