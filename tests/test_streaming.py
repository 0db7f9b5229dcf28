import os
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from txrisk.operators.stats import fit_feature_stats
from txrisk.plans import models as M
from txrisk.plans.scoring import score_table
from txrisk.schema import FEATURE_COLUMNS, PREDICTION_LOG_SCHEMA
from txrisk.sources import artifacts, tables
from txrisk.streaming.scorer import StreamScorer, read_stream, running_totals_stream


@pytest.fixture(scope="module")
def setup(spark):
    from txrisk.operators.features import engineer_features

    tx = tables.transactions(spark, SF001).cache()
    stats = fit_feature_stats(tx)
    feats, _ = engineer_features(tx, stats)
    model = M.fit(M.gradient_boosting(max_iter=5, max_depth=3), feats.select("id", "Class", *FEATURE_COLUMNS))
    return tx, stats, model


def _write_days(tx, src):
    """Transactions split by day into small parquet files, written oldest day first."""
    days = [r[0] for r in tx.select(F.floor(F.col("Time") / 86400).alias("d")).distinct().orderBy("d").collect()]
    t0 = time.time() - 10_000
    for i, d in enumerate(days):
        part = tx.filter(F.floor(F.col("Time") / 86400) == d).coalesce(1)
        out = f"{src}/day={int(d):03d}"
        part.write.mode("overwrite").parquet(out)
        for f in os.listdir(out):
            os.utime(os.path.join(out, f), (t0 + i, t0 + i))
    return len(days)


def test_stream_equals_batch_and_replay_is_idempotent(spark, setup, tmpdir_fresh):
    tx, stats, model = setup
    src = f"{tmpdir_fresh}/in"
    n_days = _write_days(tx, src)
    scorer = StreamScorer(spark, model, stats, f"{tmpdir_fresh}/log", f"{tmpdir_fresh}/state", threshold_path=f"{tmpdir_fresh}/ctl")
    stream = read_stream(spark, src, tx.schema, max_files=7)
    q = scorer.start(stream, f"{tmpdir_fresh}/ckpt")
    q.awaitTermination(600)
    log = artifacts.read_log(spark, f"{tmpdir_fresh}/log")
    assert log.count() == tx.count()
    assert log.select("tx_id").distinct().count() == tx.count()

    batch = score_table(model, tx, stats, keep=("id", "Time"), with_alert=False)
    from txrisk.operators.alerts import assign_tx_ids

    batch = assign_tx_ids(batch, ["Time", "id"])
    j = log.alias("s").join(batch.alias("b"), "tx_id")
    diff = j.select(
        F.max(F.abs(F.col("s.fraud_probability") - F.col("b.fraud_probability"))).alias("dp"),
        F.sum((F.col("s.risk_level") != F.col("b.risk_level")).cast("int")).alias("bad_risk"),
        F.sum((F.col("s.decision") != F.col("b.decision")).cast("int")).alias("bad_dec"),
        F.count("*").alias("n"),
    ).first()
    assert diff["n"] == tx.count() and diff["dp"] < 1e-9 and diff["bad_risk"] == 0 and diff["bad_dec"] == 0

    totals = scorer.dashboard_stats().first()
    assert totals["total_processed"] == tx.count()
    fraud = log.filter(F.col("risk_level") == "FRAUD").count()
    assert totals["fraud_detected"] == fraud

    # replaying the last batch replaces its attempt instead of appending
    last = max(int(p.split("=")[1]) for p in os.listdir(f"{tmpdir_fresh}/state/tail"))
    first_day = last * 7  # 7 files per trigger
    same_input = [f"{src}/day={d:03d}" for d in range(first_day, n_days)]
    scorer.process_batch(spark.read.schema(tx.schema).parquet(*same_input), last)
    assert artifacts.read_log(spark, f"{tmpdir_fresh}/log").count() == tx.count()

    # the day of a batch is the stored one, whatever the day of the replay; a lost state is an error
    spark.createDataFrame([("2001-01-01",)], "day string").write.mode("overwrite").parquet(scorer._state("day", last))
    assert scorer._batch_day(last) == "2001-01-01"
    with pytest.raises(RuntimeError):
        scorer.process_batch(tx.limit(1), last + 5)


def test_threshold_change_applies_to_next_batch(spark, setup, tmpdir_fresh):
    tx, stats, model = setup
    scorer = StreamScorer(spark, model, stats, f"{tmpdir_fresh}/log", f"{tmpdir_fresh}/state", threshold_path=f"{tmpdir_fresh}/ctl")
    assert scorer.set_threshold(5.0) == 0.99
    assert scorer.current_threshold() == 0.99
    scorer.set_threshold(0.01)
    scorer.process_batch(tx, 0)
    log = artifacts.read_log(spark, f"{tmpdir_fresh}/log")
    assert log.filter(F.col("threshold_used") != 0.01).count() == 0
    # every probability >= 0.01 is blocked at the lowest threshold
    assert log.filter((F.col("fraud_probability") >= 0.01) & (F.col("decision") != "BLOCK")).count() == 0


def test_running_totals_stream_over_log_folder(spark, setup, tmpdir_fresh):
    tx, stats, model = setup
    scorer = StreamScorer(spark, model, stats, f"{tmpdir_fresh}/log", f"{tmpdir_fresh}/state")
    scorer.process_batch(tx, 0)
    logs = spark.readStream.schema(PREDICTION_LOG_SCHEMA).json(f"{tmpdir_fresh}/log/*/*")
    q = running_totals_stream(logs).writeStream.outputMode("complete").format("memory").queryName("rt_totals").trigger(availableNow=True).start()
    q.awaitTermination(300)
    row = spark.sql("select * from rt_totals").first()
    assert row["total_processed"] == tx.count()
    assert row["n_safe"] + row["n_suspicious"] + row["n_fraud"] == tx.count()


def test_latest_log_skips_malformed_lines(spark, tmpdir_fresh):
    d1 = f"{tmpdir_fresh}/log/log_date=2026-01-01"
    d2 = f"{tmpdir_fresh}/log/log_date=2026-01-02"
    os.makedirs(d1)
    os.makedirs(d2)
    with open(f"{d1}/a.json", "w") as f:
        f.write('{"tx_id": "TX_000001", "fraud_score": 80.0, "risk_level": "FRAUD"}\n')
    with open(f"{d2}/a.json", "w") as f:
        f.write('{"tx_id": "TX_000002", "fraud_score": 10.0, "risk_level": "SAFE"}\n{broken\n')
        f.write('{"tx_id": "TX_000003", "fraud_score": 50.0, "risk_level": "SUSPICIOUS"}\n')
    open(f"{d2}/empty.json", "w").close()
    latest = artifacts.read_latest_log(spark, f"{tmpdir_fresh}/log")
    assert sorted(r["tx_id"] for r in latest.collect()) == ["TX_000002", "TX_000003"]
    assert artifacts.read_log(spark, f"{tmpdir_fresh}/nothing").count() == 0


def test_readers_see_committed_attempts_only(spark, tmpdir_fresh):
    log = f"{tmpdir_fresh}/log"
    rows = lambda n, tag: spark.range(n).select(F.concat(F.lit(tag), F.col("id").cast("string")).alias("tx_id"), *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in PREDICTION_LOG_SCHEMA.fields if f.name != "tx_id"])
    ids = lambda df: sorted(r.tx_id for r in df.collect())
    artifacts.write_log_batch(rows(2, "a"), log, "2026-01-01", 0)
    artifacts.write_log_batch(rows(3, "b"), log, "2026-01-02", 1)
    before = artifacts.read_log(spark, log)
    assert ids(before) == ["a0", "a1", "b0", "b1", "b2"]
    # half a replay of batch 1: rows written, not committed; nothing changes for readers, old and new
    rows(1, "c").write.json(f"{log}/log_date=2026-01-02/batch_id=1-a_half")
    assert ids(artifacts.read_log(spark, log)) == ids(before)
    artifacts.write_log_batch(rows(4, "d"), log, "2026-01-02", 1)
    assert ids(artifacts.read_log(spark, log)) == ["a0", "a1", "d0", "d1", "d2", "d3"]
    assert ids(before) == ["a0", "a1", "b0", "b1", "b2"]  # a reader that started earlier still has the batch it saw
    # a later day with an uncommitted attempt is not the last day; only the last day's files are read
    rows(1, "e").write.json(f"{log}/log_date=2026-01-03/batch_id=2-a_half")
    assert artifacts.last_log_day(spark, log) == "2026-01-02"
    latest = artifacts.read_latest_log(spark, log)
    assert ids(latest) == ["d0", "d1", "d2", "d3"]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2026-01-02" in plan.split("PartitionFilters", 1)[1][:200]
    artifacts.write_log_batch(rows(0, "f"), log, "2026-01-04", 3)  # an empty batch
    assert artifacts.read_latest_log(spark, log).count() == 0


def test_alert_page_over_latest_log(spark, setup, tmpdir_fresh):
    from txrisk.plans.scoring import alert_page

    tx, stats, model = setup
    scorer = StreamScorer(spark, model, stats, f"{tmpdir_fresh}/log", f"{tmpdir_fresh}/state")
    scorer.process_batch(tx, 0)
    counts, board = alert_page(spark, f"{tmpdir_fresh}/log")
    c = counts.first()
    assert c["total_alerts"] == tx.count() and c["n_safe"] + c["n_suspicious"] + c["n_fraud"] == tx.count()
    rows = board.collect()
    assert len(rows) <= 100 and all(r["risk_level"] in ("SUSPICIOUS", "FRAUD") for r in rows)
    scores = [r["fraud_score"] for r in rows]
    assert scores == sorted(scores, reverse=True)
    _, everything = alert_page(spark, f"{tmpdir_fresh}/log", levels=[])
    assert everything.count() == min(100, tx.count())


def test_running_statistics_survive_a_restart(spark, tmpdir_fresh):
    from txrisk.streaming import running

    rows = [(f"TX_{i:06d}", (i * 37 % 1001) / 10.0, ["SAFE", "SUSPICIOUS", "FRAUD"][(i * 37 % 1001 >= 300) + (i * 37 % 1001 >= 700)], "REVIEW") for i in range(1, 301)]
    schema = "tx_id string, fraud_score double, risk_level string, decision string"
    own = running.stream_session(spark, 4)

    def arrive(first, last):
        for k in range(first, last):  # a file each, in order
            spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.parquet(f"{tmpdir_fresh}/in/part={k}")
            for f in os.listdir(f"{tmpdir_fresh}/in/part={k}"):
                os.utime(f"{tmpdir_fresh}/in/part={k}/{f}", (1_600_000_000 + 60 * k,) * 2)
        stream = read_stream(own, f"{tmpdir_fresh}/in", schema, max_files=1)
        running.start(stream, f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ckpt", shards=5).awaitTermination()
        return running.statistics(spark, f"{tmpdir_fresh}/out").first()

    for s, done in ((arrive(0, 2), rows[:100]), (arrive(2, 6), rows)):  # a new query goes on from the checkpoint
        assert s["total_processed"] == len(done) and s["fraud_detected"] == sum(r[2] == "FRAUD" for r in done) == s["alert_distribution"]["FRAUD"]
        assert s["avg_score"] == sum(round(r[1] * 10) for r in done) / 10.0 / len(done)
        assert [a["tx_id"] for a in s["recent_alerts"]] == [r[0] for r in done[-20:]]
    assert len(os.listdir(f"{tmpdir_fresh}/ckpt/commits")) >= 6  # one micro-batch a file
