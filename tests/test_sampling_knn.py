import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from txrisk.operators import knn, sampling
from txrisk.schema import V_COLUMNS
from txrisk.sources import tables


def test_split_sizes_reproduce_published_test_split():
    assert sampling.split_sizes({0: 284315, 1: 492}, 0.2) == {0: 56864, 1: 98}


def test_split_exact_disjoint_and_partition_independent(spark):
    tx = tables.transactions(spark, SF001)
    a = sampling.with_split(tx)
    b = sampling.with_split(tx.repartition(5))
    counts = {(r["Class"], r["split"]): r["count"] for r in a.groupBy("Class", "split").count().collect()}
    cc = sampling.class_counts_map(tx)
    exp = sampling.split_sizes(cc, 0.2)
    for c in cc:
        assert counts[(c, "test")] == exp[c] and counts[(c, "train")] == cc[c] - exp[c]
    assert a.select("id").distinct().count() == tx.count()
    sa = {r["id"]: r["split"] for r in a.collect()}
    sb = {r["id"]: r["split"] for r in b.collect()}
    assert sa == sb


def test_undersample_and_cap(spark):
    tx = tables.transactions(spark, SF001)
    cc = sampling.class_counts_map(tx)
    u = sampling.random_undersample(tx, ratio=2.0)
    got = sampling.class_counts_map(u)
    assert got[1] == cc[1] and got[0] == min(int(cc[1] * 2.0), cc[0])
    capped = sampling.cap_majority(tx, max_rows=100, keep_majority=50)
    g2 = sampling.class_counts_map(capped)
    assert g2[1] == cc[1] and g2[0] == 50
    assert sampling.cap_majority(tx, max_rows=10**9).count() == tx.count()


def test_folds_are_stratified(spark):
    tx = tables.transactions(spark, SF001)
    f = sampling.stratified_folds(tx, 3)
    for r in f.groupBy("Class").agg(F.min("fold"), F.max("fold")).collect():
        assert (r[1], r[2]) == (0, 2)
    sizes = f.groupBy("Class", "fold").count().collect()
    by_class = {}
    for r in sizes:
        by_class.setdefault(r["Class"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by_class.values())


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "Class int")
    w = {r["Class"]: r["weight"] for r in sampling.class_weights(df).collect()}
    assert w == pytest.approx({0: 10 / 18, 1: 5.0})


def _brute_knn(X, ids, k):
    D = np.stack([knn.distances(x, X) for x in X])
    out = {}
    for qi in range(len(ids)):
        order = [o for o in np.lexsort((ids, D[qi])) if o != qi][:k]
        out[int(ids[qi])] = [int(ids[o]) for o in order]
    return out


@pytest.mark.parametrize(("tile", "spread"), [(4096, 0.0), (8, 0.0), (8, 3.0)])
def test_knn_exact_against_brute_force(spark, tile, spread, monkeypatch):
    monkeypatch.setattr(knn, "TILE", tile)
    monkeypatch.setattr(knn, "GROUP", 2)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 4)) * np.exp(spread * rng.normal(size=(60, 1)))  # lengths over many octaves: far tiles are left out
    X = np.vstack([base, base[:10], base[:10] + 1e-3, base[:3], base[:3], np.round(base), np.zeros((1, 4))])  # copies, near copies, ties
    ids = np.arange(len(X)) * 3 + 1
    df = spark.createDataFrame([(int(i), *map(float, x)) for i, x in zip(ids, X)], "id long, a double, b double, c double, d double")
    got = knn.knn(df, ["a", "b", "c", "d"], 5)
    g = {}
    for r in got.orderBy("id", "rank").collect():
        g.setdefault(r["id"], []).append(r["nid"])
    assert g == _brute_knn(X, ids, 5)


def test_tiles_are_full_and_far_ones_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(knn, "TILE", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 3)) + 10.0 ** (np.arange(100)[:, None] // 10)  # ten shells of lengths far apart
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<double>")
    dv = knn.distinct_vectors(df, "id", "vec", 2)
    sizes = sorted(r.n for r in knn.tiles(dv, 2).collect())
    assert sizes == [4, 16, 16, 16, 16, 16, 16]
    near = knn.Nearest(np.arange(2), x[:2], np.full(2, np.inf), 2)
    near.show(np.arange(100), x)
    before = [i.tolist() for _, i in near.found]
    near.show(np.arange(90, 100), x[90:])  # a tile beyond the bounds changes nothing
    assert [i.tolist() for _, i in near.found] == before


def test_knn_needs_two_rows(spark):
    df = spark.createDataFrame([(1, 0.0)], "id long, a double")
    with pytest.raises(ValueError):
        knn.knn(df, ["a"], 5)


def test_smote_invariants(spark):
    tx = tables.transactions(spark, SF001)
    out = sampling.smote(tx, V_COLUMNS, k_neighbors=5)
    cc = sampling.class_counts_map(out)
    assert cc[0] == cc[1]
    syn = out.filter("is_synthetic")
    n_min = tx.filter("Class = 1").count()
    n_maj = tx.count() - n_min
    assert syn.count() == n_maj - n_min
    # every synthetic coordinate lies between its base row and some minority row (here: a base copy or a neighbour)
    mino = tx.filter("Class = 1").select(F.col("id").alias("base_id"), *[F.col(c).alias(f"b_{c}") for c in V_COLUMNS])
    j = syn.join(mino, "base_id")
    nb = knn.knn(tx.filter("Class = 1"), V_COLUMNS, 5)
    nv = tx.filter("Class = 1").select(F.col("id").alias("nid"), *[F.col(c).alias(f"n_{c}") for c in V_COLUMNS])
    pairs = nb.join(nv, "nid").groupBy(F.col("id").alias("base_id")).agg(
        *[F.min(f"n_{c}").alias(f"mn_{c}") for c in V_COLUMNS], *[F.max(f"n_{c}").alias(f"mx_{c}") for c in V_COLUMNS]
    )
    jj = j.join(pairs, "base_id")
    eps = 1e-9
    bad = None
    for c in V_COLUMNS:
        cond = (F.col(c) < F.least(F.col(f"b_{c}"), F.col(f"mn_{c}")) - eps) | (F.col(c) > F.greatest(F.col(f"b_{c}"), F.col(f"mx_{c}")) + eps)
        bad = cond if bad is None else bad | cond
    assert jj.filter(bad).count() == 0
    # same rows for the same seed, any partitioning
    again = sampling.smote(tx.repartition(3), V_COLUMNS, k_neighbors=5).filter("is_synthetic")
    a = {r["id"]: r["V1"] for r in syn.select("id", "V1").collect()}
    b = {r["id"]: r["V1"] for r in again.select("id", "V1").collect()}
    assert a == b


def test_smote_early_exit_and_error(spark):
    schema = "id long, Class int, a double"
    balanced = spark.createDataFrame([(1, 0, 0.0), (2, 1, 1.0)], schema)
    assert sampling.smote(balanced, ["a"]).count() == 2
    lonely = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0), (3, 1, 2.0)], schema)
    with pytest.raises(ValueError):
        sampling.smote(lonely, ["a"])
    two = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0), (3, 0, 5.0), (4, 1, 2.0), (5, 1, 4.0)], schema)
    out = sampling.smote(two, ["a"], k_neighbors=5)  # k lowered to n_min - 1 = 1
    syn = out.filter("is_synthetic").collect()
    assert len(syn) == 1 and 2.0 <= syn[0]["a"] <= 4.0


def test_stratified_split_pair_is_disjoint_and_covering(spark):
    tx = tables.transactions(spark, SF001)
    train, test = sampling.stratified_split(tx, test_size=0.25, seed=7)
    tr = {r["id"] for r in train.select("id").collect()}
    te = {r["id"] for r in test.select("id").collect()}
    assert not (tr & te) and len(tr | te) == tx.count()
    exp = sampling.split_sizes(sampling.class_counts_map(tx), 0.25)
    got = sampling.class_counts_map(test)
    assert got == exp
