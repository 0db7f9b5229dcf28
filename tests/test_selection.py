"""Radix selection and the portable draws against plain sorting."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from txrisk.functions import hashing
from txrisk.operators import sampling, selection


def md5_draw(seed, salt, *keys):
    return int(hashlib.md5("|".join(map(str, (seed, salt, *keys))).encode()).hexdigest()[:13], 16)


def test_draws_are_the_same_in_python_and_duckdb(spark):
    rows = [(i * 977 - 300, i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, s int")
    got = {tuple(r) for r in df.select("id", "s", hashing.draw(42, "id", "s", salt=3).alias("h"), hashing.uniform(42, "id", "s", salt=3).alias("u")).collect()}
    assert got == {(i, s, md5_draw(42, 3, i, s), md5_draw(42, 3, i, s) / 2**52) for i, s in rows}
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT * FROM (VALUES " + ", ".join(map(str, rows)) + ") v(id, s)")
    sql = f"SELECT id, s, {hashing.sql_draw(42, 'id', 's', salt=3)}, {hashing.sql_uniform(42, 'id', 's', salt=3)} FROM t"
    assert set(con.execute(sql).fetchall()) == got


@pytest.mark.parametrize(("bits", "digit", "fetch"), [(52, 13, 4096), (52, 5, 3), (6, 2, 1), (6, 13, 4096)])
def test_limits_equal_sorting(spark, monkeypatch, bits, digit, fetch):
    """Any depth of rounds, ties of the draw down to the id, ids on several rows, a null class and an absent one."""
    monkeypatch.setattr(selection, "DIGIT", digit)
    monkeypatch.setattr(selection, "FETCH", fetch)
    rows = [(i, [None, "a", "b"][i % 3 if i % 5 else 1], md5_draw(1, 0, i) >> (52 - bits)) for i in range(400)]
    rows += [(7, "a", md5_draw(1, 0, 7) >> (52 - bits))] * 3
    df = spark.createDataFrame(rows, "id long, c string, h long").repartition(5)
    ranks = {"a": [1, 17, 100, 10_000], "b": [0, 3], None: [50], "absent": [4]}
    got = selection.rank_limits(df, F.col("h"), "id", ranks, "c", bits=bits)
    for c, own in ranks.items():
        order = sorted((h, i) for i, k, h in rows if k == c)
        assert got[c] == [order[min(r, len(order)) - 1] if r >= 1 and order else None for r in own]
    limits = {c: v[0] for c, v in got.items()}
    kept = {(r.id, r.c) for r in df.filter(selection.up_to(F.col("h"), "id", limits, "c")).collect()}
    assert kept == {(i, c) for i, c, h in rows if limits.get(c) and (h, i) <= limits[c]}


def test_split_reads_rows_without_sort_or_shuffle(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("Class"))
    plan = sampling.with_split(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Sort", "Join", "Window"))


def test_whole_none_and_empty_selections(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(10)], "id long, Class int")
    assert sampling.random_undersample(df, ratio=0.0).count() == 3
    assert sampling.random_undersample(df, ratio=100.0).count() == 10
    assert sampling.cap_majority(df, max_rows=5, keep_majority=0).count() == 3
    folds = sampling.stratified_folds(df, 5)
    assert sorted(folds.filter("Class = 1").select("fold").collect()) == [(0,), (1,), (2,)]
    empty = df.limit(0)
    assert sampling.with_split(empty).count() == 0 and sampling.stratified_folds(empty, 3).count() == 0
