import math

import pytest
from pyspark.sql import functions as F

from txrisk.operators import cleaning, eda, stats
from txrisk.operators.features import engineer_features
from txrisk.schema import EXPECTED_COLUMNS, V_COLUMNS
from txrisk.sources import ingest


def _row(time, amount, cls, v=0.0):
    return [time, amount, cls] + [v] * 28


def test_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        _row(1.0, 10.0, 0),
        _row(2.0, nan, 0),
        _row(3.0, inf, 1),
        _row(4.0, -inf, 0),
        _row(5.0, 30.0, None),
        _row(6.0, 20.0, 2),
        _row(7.0, 40.0, -1),
        _row(None, 50.0, 1),
    ]
    schema = "Time double, Amount double, Class int, " + ", ".join(f"{c} double" for c in V_COLUMNS)
    df = spark.createDataFrame(rows, schema).withColumn("V7", F.lit(None).cast("double"))
    out = cleaning.clean(df).orderBy("Time").collect()
    assert len(out) == 5  # labels NULL, 2, -1 dropped
    # non-finite -> NULL -> median of the valid-label rows' finite values: Amount (10, 50) -> 30, Time (1..4) -> 2.5
    assert [(r["Time"], r["Amount"]) for r in out] == [(1.0, 10.0), (2.0, 30.0), (2.5, 50.0), (3.0, 30.0), (4.0, 30.0)]
    assert all(r["V7"] is None for r in out)  # all-NULL column stays NULL
    assert all(r["Time"] is not None for r in out)


def test_csv_schema_validation(spark, tmpdir_fresh):
    header = [c for c in EXPECTED_COLUMNS if c != "V7"]
    with open(f"{tmpdir_fresh}/bad.csv", "w") as f:
        f.write(",".join(header) + "\n" + ",".join("1" for _ in header) + "\n")
    with pytest.raises(ingest.SchemaError, match="V7"):
        ingest.read_transactions_csv(spark, f"{tmpdir_fresh}/bad.csv")


def test_csv_shuffled_and_extra_columns_bind_by_name(spark, tmpdir_fresh):
    cols = list(reversed(EXPECTED_COLUMNS)) + ["extra"]
    vals = {c: str(i + 0.5) for i, c in enumerate(EXPECTED_COLUMNS)}
    vals["Class"] = "1"
    vals["Amount"] = "inf"
    with open(f"{tmpdir_fresh}/ok.csv", "w") as f:
        f.write(",".join(cols) + "\n")
        f.write(",".join(vals.get(c, "x") for c in cols) + "\n")
        f.write(",".join(vals.get(c, "x") if c != "Class" else "1.5" for c in cols) + "\n")
    df = ingest.read_transactions_csv(spark, f"{tmpdir_fresh}/ok.csv")
    assert df.columns == ["id"] + EXPECTED_COLUMNS
    r = df.orderBy("id").first()
    assert r["Time"] == 0.5 and r["V1"] == float(vals["V1"])
    assert math.isinf(r["Amount"])
    assert df.filter(F.col("Class").isNull()).count() == 1  # non-integer label -> NULL -> dropped later
    assert ingest.read_transactions_csv(spark, f"{tmpdir_fresh}/ok.csv", limit=1).count() == 1


def _csv(path, ids, rows):
    with open(path, "w") as f:
        f.write(",".join((["id"] if ids else []) + EXPECTED_COLUMNS) + "\n")
        for i, r in enumerate(rows):
            f.write(",".join(([ids[i]] if ids else []) + r) + "\n")


def test_csv_ids(spark, tmpdir_fresh):
    from txrisk.operators.sampling import with_split

    rows = [[str(i + 1) if c != "Class" else str(i % 2) for c in EXPECTED_COLUMNS] for i in range(40)]
    _csv(f"{tmpdir_fresh}/text.csv", [f"TX{i}" for i in range(40)], rows)
    text = ingest.read_transactions_csv(spark, f"{tmpdir_fresh}/text.csv")
    assert dict(text.dtypes)["id"] == "string" and with_split(cleaning.clean(text)).count() == 40
    _csv(f"{tmpdir_fresh}/whole.csv", [str(i) for i in range(40)], rows)
    assert dict(ingest.read_transactions_csv(spark, f"{tmpdir_fresh}/whole.csv").dtypes)["id"] == "bigint"
    _csv(f"{tmpdir_fresh}/twice.csv", ["1", "1"], rows[:2])
    _csv(f"{tmpdir_fresh}/null.csv", ["1", ""], rows[:2])
    for name in ("twice", "null"):
        with pytest.raises(ingest.SchemaError):
            ingest.read_transactions_csv(spark, f"{tmpdir_fresh}/{name}.csv")


def test_content_ids_do_not_depend_on_partitions(spark):
    from txrisk.operators.ordering import with_content_ids

    df = spark.range(60).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("b"))
    one = sorted(map(str, with_content_ids(df.repartition(1)).collect()))
    many = sorted(map(str, with_content_ids(df.repartition(6)).collect()))
    assert one == many and len(set(one)) == 60
    assert with_content_ids(df.limit(0)).count() == 0


def test_constant_amount_and_single_row(spark):
    schema = "id long, Time double, Amount double, Class int, " + ", ".join(f"{c} double" for c in V_COLUMNS)
    rows = [[i, float(i * 10), 5.0, i % 2] + [float(i)] * 28 for i in range(50)]
    df = spark.createDataFrame(rows, schema)
    feats, st = engineer_features(df)
    assert st.amount_scale == 1.0  # zero IQR -> divisor 1
    assert feats.filter(F.col("Amount_scaled") != 0.0).count() == 0
    assert feats.filter(F.col("is_high_amount") != 0).count() == 0
    one = spark.createDataFrame([rows[0]], schema)
    f1, s1 = engineer_features(one)
    r = f1.first()
    assert s1.hours_std is None and r["Time_scaled"] is None  # sample std of one row is undefined
    assert r["tx_velocity"] == 1.0 and r["rolling_avg_amount"] == 5.0 and r["amount_deviation"] == 0.0


def test_time_ties_rolling_is_deterministic(spark):
    schema = "id long, Time double, Amount double, Class int, " + ", ".join(f"{c} double" for c in V_COLUMNS)
    rows = [[i, float(i % 5), float(i), 0] + [0.0] * 28 for i in range(250)]
    df = spark.createDataFrame(rows, schema)
    a, _ = engineer_features(df)
    b, _ = engineer_features(df.repartition(7))
    ra = {r["id"]: r["rolling_avg_amount"] for r in a.collect()}
    rb = {r["id"]: r["rolling_avg_amount"] for r in b.collect()}
    assert ra == rb


def test_stats_and_class_counts_with_absent_class(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0), (3600.0, 3.0, 0)], "Time double, Amount double, Class int")
    cc = {r["Class"]: r["count"] for r in eda.class_counts(df).collect()}
    assert cc == {0: 2, 1: 0}
    s = stats.dataset_stats(df).first()
    assert s["fraud_count"] == 0 and s["imbalance_ratio"] == 2.0 and s["time_range_hours"] == 1.0
    assert s["amount_p50"] == 2.0 and s["amount_std"] == pytest.approx(math.sqrt(2.0))


def test_quantiles_equal_numpy(spark):
    import numpy as np

    vals = [((i * 7919) % 1001) / 3.0 for i in range(1001)]
    df = spark.createDataFrame([(v, None if i % 5 else v, None) for i, v in enumerate(vals)], "Amount double, some double, none double")
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = stats.quantiles(df, ["Amount", "some", "none"], probs)
    assert got["Amount"] == pytest.approx(np.quantile(vals, probs).tolist(), abs=1e-12)
    assert got["some"] == pytest.approx(np.quantile(vals[::5], probs).tolist(), abs=1e-12)
    assert got["none"] == [None] * 5
    assert stats.quantiles(df.limit(0), ["Amount"], [0.5]) == {"Amount": [None]}


def test_quantiles_with_many_ties_and_any_partitioning(spark):
    import numpy as np

    # 60 % of the rows share one value; the bits do not depend on how the rows are dealt
    vals = [[7.1 if i % 5 < 3 else ((i * 7919) % 1001) / 7.0 for i in range(g, 20011, 3)] for g in range(3)]
    df = spark.createDataFrame([(g, v) for g, own in enumerate(vals) for v in own], "g int, v double")
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = stats.quantiles_by(df, "g", "v", probs)
    assert got == stats.quantiles_by(df.repartition(13), "g", "v", probs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert got == stats.quantiles_by(df, "g", "v", probs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g, own in enumerate(vals):
        assert got[g] == pytest.approx(np.quantile(own, probs).tolist(), abs=1e-9)


def test_histogram_bins_at_their_edges(spark):
    edges = eda.log_edges(0.5, 9000.0)
    vals = sorted({v for e in edges for v in (e, math.nextafter(e, 0), math.nextafter(e, 1e9)) if 0.5 <= v <= 9000.0} | {0.5, 9000.0})
    df = spark.createDataFrame([(v, 0) for v in vals] + [(None, 0)], "Amount double, Class int")
    want: dict = {}
    for v in vals:
        k = sum(e <= v for e in edges) - 1
        if k >= 0:
            want[min(k, 48)] = want.get(min(k, 48), 0) + 1
    assert {r["bin"]: r["count"] for r in eda.amount_histogram(df).collect()} == want


def test_time_does_not_depend_on_session_time_zone(spark):
    from tests.conftest import SF001
    from txrisk.sources import tables

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        a = {r[0]: r[1] for r in tables.transactions_li(spark, SF001).select(F.monotonically_increasing_id(), "Time").collect()}
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")  # lineitem dates cross DST changes
        b = {r[0]: r[1] for r in tables.transactions_li(spark, SF001).select(F.monotonically_increasing_id(), "Time").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert a == b


def test_first_rows_are_the_same_on_any_number_of_splits(spark, tmpdir_fresh):
    import os

    folder = f"{tmpdir_fresh}/in"
    os.makedirs(folder)
    lines = []
    for k, n in enumerate([3, 0, 400, 250, 1, 500]):
        own = [f"{len(lines) + i},{'x' * ((len(lines) + i) % 23)}" for i in range(n)]
        lines += own
        with open(f"{folder}/part {k}.csv", "w") as f:
            f.write("\n".join(["id,v", *own]) + "\n")
    want = [int(x.split(",")[0]) for x in lines]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for n in (0, 1, 3, 4, 150, 403, 404, 700, 1153, 1154, 5000):
                got = ingest.first_rows(spark, folder, n).select("id", "v").collect()
                assert sorted(int(r.id) for r in got) == want[:n]
                assert all((r.v or "") == "x" * (int(r.id) % 23) for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
