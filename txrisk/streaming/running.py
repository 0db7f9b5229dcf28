"""Running statistics with the last predictions, kept in the state store.

Predictions are dealt to ``shards`` keys by the hash of their id, so no task sees them all; a shard's state is five
counters and its last ``keep`` predictions.  Every micro-batch sends the changed shards' states to the sink, one row
each, into ``out_dir/batch_id=<n>``: a batch replayed after a failure writes the same rows again.  The statistics are
the newest row of each shard, added up, and the last predictions of all shards.

State lives in the query's checkpoint: a query started again goes on where it stopped.  Scores have one decimal and are
added up in whole tenths, so the average does not depend on batches or shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from txrisk.schema import DEFAULT_THRESHOLD, RISK_LEVELS

KEEP = 20
SHARDS = 16
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COUNTS = ["total_processed", "tenths", *[f"n_{lvl.lower()}" for lvl in RISK_LEVELS]]
_LAST = ["seq", "tx_id", "fraud_score", "risk_level", "decision"]
_LAST_SCHEMA = "seq long, tx_id string, fraud_score double, risk_level string, decision string"
_OUT_SCHEMA = f"shard int, {', '.join(f'{c} long' for c in _COUNTS)}, last array<struct<{_LAST_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"


class _Shard(StatefulProcessor):
    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", ", ".join(f"{c} long" for c in _COUNTS))
        self.last = handle.getListState("last", _LAST_SCHEMA)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        counts = list(self.counts.get()) if self.counts.exists() else [0] * len(_COUNTS)
        last = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        for part in rows:
            counts[0] += len(part)
            counts[1] += int(part["tenths"].sum())
            for i, level in enumerate(RISK_LEVELS):
                counts[2 + i] += int((part["risk_level"] == level).sum())
            newest = part.nlargest(self.keep, "seq", keep="all").sort_values(["seq", "tx_id"]).tail(self.keep)
            last = sorted([*last, *newest[_LAST].itertuples(index=False, name=None)], key=lambda r: (r[0], r[1]))[-self.keep :]
        self.counts.update(tuple(counts))
        self.last.put(last)
        yield pd.DataFrame({"shard": [key[0]], **{c: [v] for c, v in zip(_COUNTS, counts, strict=True)}, "last": [[dict(zip(_LAST, r, strict=True)) for r in last]]})

    def close(self) -> None:
        pass


def sequence_number() -> Column:
    """The number in an id of the form TX_%06d."""
    return F.regexp_extract("tx_id", r"(\d+)$", 1).cast("long")


def stream_session(spark: SparkSession, partitions: int = SHARDS) -> SparkSession:
    """A session of its own for the stateful query: its state store setting touches no other query."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


def start(predictions: DataFrame, out_dir: str, checkpoint: str, keep: int = KEEP, shards: int = SHARDS, seq: Column | None = None, trigger: dict | None = None):
    """Start the query over a stream of predictions (tx_id, fraud_score, risk_level, decision) of a :func:`stream_session`.

    ``seq`` says which predictions are the last ones; by default the number in the id.
    """
    rows = predictions.select((seq if seq is not None else sequence_number()).alias("seq"), "tx_id", "fraud_score", "risk_level", "decision")
    rows = rows.withColumns({"tenths": F.round(F.col("fraud_score") * 10).cast("long"), "shard": F.pmod(F.xxhash64("tx_id"), F.lit(shards)).cast("int")})
    states = rows.groupBy("shard").transformWithStateInPandas(_Shard(keep), _OUT_SCHEMA, "update", "none")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    w = states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def statistics(spark: SparkSession, out_dir: str, keep: int = KEEP, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row: totals, distribution, rate, threshold and ``recent_alerts``, the last ``keep`` predictions, oldest first."""
    rows = spark.read.schema(f"{_OUT_SCHEMA}, batch_id long").parquet(out_dir)
    states = rows.groupBy("shard").agg(F.max_by(F.struct(*_COUNTS, "last"), "batch_id").alias("s")).select("s.*")  # one row a shard
    last = F.slice(F.sort_array(F.flatten(F.collect_list("last")), asc=False), 1, keep)  # keep entries a shard
    t = states.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in _COUNTS], F.reverse(last).alias("recent_alerts"))
    n = F.col("total_processed")
    levels = [f"n_{lvl.lower()}" for lvl in RISK_LEVELS]
    return t.select(
        "total_processed",
        F.col("n_fraud").alias("fraud_detected"),
        F.coalesce(F.try_divide(F.col("tenths") / 10.0, n), F.lit(0.0)).alias("avg_score"),
        *levels,
        F.create_map(*[x for lvl, c in zip(RISK_LEVELS, levels) for x in (F.lit(lvl), F.col(c))]).alias("alert_distribution"),
        F.round(F.col("n_fraud") / F.greatest(n, F.lit(1)) * 100.0, 2).alias("fraud_rate_pct"),
        F.lit(float(threshold)).alias("current_threshold"),
        "recent_alerts",
    )
