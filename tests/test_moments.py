"""One-pass moments against numpy, and positions of few rows against sorting."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import alerts, moments, ordering


def test_moments_and_correlation_per_group(spark):
    rng = np.random.default_rng(3)
    n = 600
    g, y = rng.integers(0, 3, n), rng.integers(0, 4, n)
    a = 1e6 + rng.normal(size=n) + y  # far from zero: sums of squares would lose digits
    b = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n) * (y + 1))  # null in a third of the rows
    rows = [(None if i == 2 else int(i), int(k), float(u), None if np.isnan(v) else float(v), 7.5, None) for i, k, u, v in zip(g, y, a, b)]
    rows += [(0, None, 1e6, 5.0, 7.5, None)]  # no label
    df = spark.createDataFrame(rows, "g int, y int, a double, b double, c double, d double").repartition(7)
    parts = moments.label_moments(df, ["a", "b", "c", "d"], "y", [F.col("g")])
    got = {(r.g, r.feature): r for r in moments.moments(parts, ["g"]).collect()}
    corr = {(r.g, r.feature): r.correlation for r in moments.label_correlation(parts, ["g"]).collect()}
    assert {f for _, f in got} == {"a", "b", "c"}  # d has no value at all
    for group in (0, 1, None):
        for f, col in (("a", 2), ("b", 3), ("c", 4)):
            own = [(r[col], r[1]) for r in rows if r[0] == group and r[col] is not None]
            x = np.array([v for v, _ in own])
            r = got[(group, f)]
            assert r.n == len(x) and r.mean == pytest.approx(x.mean(), rel=1e-12) and r.std == pytest.approx(x.std(ddof=1), rel=1e-9, abs=1e-9)
            xy = np.array([(v, k) for v, k in own if k is not None], float)
            want = 0.0 if f == "c" else np.corrcoef(xy.T)[0, 1]
            assert corr[(group, f)] == pytest.approx(want, abs=1e-9)


def test_moments_do_not_unpivot_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2).alias("b"), (F.col("id") % 2).alias("y"))
    parts = moments.label_moments(df, ["a", "b"], "y")
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan and "Exchange" not in plan
    assert moments.moments(moments.label_moments(df.limit(0), ["a"], "y")).count() == 0
    one = moments.moments(moments.label_moments(df.limit(1), ["a"], "y")).collect()
    assert [(r.n, r.std) for r in one] == [(1, None)]


def test_positions_of_few_rows(spark):
    rows = [(i, float(i // 7 % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, Time double").repartition(5)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    keys = [(t, i) for i, t in (rows[5], rows[200], rows[6], order[0], order[-1], rows[5])] + [(3.0, 10**9), (99.0, 1), (-1.0, 1)]
    want = [sum((r[1], r[0]) < k for r in rows) for k in keys]
    assert ordering.positions_of(df, "Time", "id", keys) == want
    assert ordering.positions_of(df, "Time", "id", []) == []


def test_reports_without_numbering_equal_reports_with_ids(spark):
    rows = [(i, float(i * 37 % 50), (i * 7919 % 1000) / 1000.0) for i in range(400)]
    scored = alerts.score(spark.createDataFrame(rows, "id long, Time double, fraud_probability double"))
    numbered = alerts.assign_tx_ids(scored, ["Time", "id"])
    plain = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    cols = ("tx_id", "fraud_score", "risk_level", "decision")
    for levels in (None, ["FRAUD"], ["SAFE", "SUSPICIOUS"]):
        assert sorted(plain(alerts.table_board(scored, levels), *cols)) == sorted(plain(alerts.alert_board(numbered, levels), *cols))
    assert plain(alerts.table_recent(scored, 20), *cols) == plain(numbered.orderBy(F.col("Time").desc(), F.col("id").desc()).limit(20), *cols)
    assert plain(alerts.table_head(scored, 30), *cols) == plain(alerts.first_n(numbered, 30, ["Time", "id"]), *cols)
    assert alerts.table_board(scored.limit(0)).count() == 0
