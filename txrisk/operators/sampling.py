"""Splitting and rebalancing with exact counts and partition-independent randomness.

Every row has a draw from its id.  The n rows of a class with the smallest (draw, id)
are those up to the n-th one's, which :mod:`txrisk.operators.selection` finds from counts
of prefixes: splits, samples and folds are filters on the row's own draw, without sort,
shuffle or join.  Per-class counts (one row per class) and counts of prefixes reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions.hashing import draw, uniform
from txrisk.operators.ordering import attach_positions
from txrisk.operators.selection import rank_limits, up_to


def class_counts_map(df: DataFrame, label: str = "Class") -> dict[int, int]:
    """{class: rows}; one aggregated row per class."""
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def largest_remainder(counts: dict, total_draws: int) -> dict:
    """Share ``total_draws`` over classes proportionally; leftovers go to the largest remainders.

    Remainder ties go to the class listed first (ascending label).
    """
    n = sum(counts.values())
    keys = sorted(counts)
    cont = {c: total_draws * counts[c] / n for c in keys}
    out = {c: int(math.floor(cont[c])) for c in keys}
    left = total_draws - sum(out.values())
    for c in sorted(keys, key=lambda c: (-(cont[c] - out[c]), keys.index(c)))[:left]:
        out[c] += 1
    return out


def split_sizes(counts: dict, test_size: float = 0.2) -> dict:
    """Per-class test rows of a stratified split: n_test = ceil(test_size * n);
    the train share is allocated by largest remainder and test takes the rest."""
    n = sum(counts.values())
    n_test = int(math.ceil(test_size * n))
    train = largest_remainder(counts, n - n_test)
    return {c: counts[c] - train[c] for c in counts}


def _first_in_class(df: DataFrame, sizes: dict, label: str, seed: int, id_col: str):
    """Column: is the row among the ``sizes[class]`` first ones of its class in (draw, id) order?"""
    d = draw(seed, id_col)
    limits = rank_limits(df, d, id_col, {c: [n] for c, n in sizes.items()}, label)
    return up_to(d, id_col, {c: v[0] for c, v in limits.items()}, label)


def with_split(df: DataFrame, label: str = "Class", test_size: float = 0.2, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Exact stratified split as a column ``split`` in {'train', 'test'}; per-class sizes as computed by :func:`split_sizes`."""
    in_test = _first_in_class(df, split_sizes(class_counts_map(df, label), test_size), label, seed, id_col)
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def stratified_split(
    df: DataFrame, label: str = "Class", test_size: float = 0.2, seed: int = 42, id_col: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """The same split as a pair (train, test), disjoint and covering."""
    in_test = _first_in_class(df, split_sizes(class_counts_map(df, label), test_size), label, seed, id_col)
    return df.filter(~in_test), df.filter(in_test)


def undersample_size(n_min: int, n_maj: int, ratio: float) -> int:
    return min(int(n_min * ratio), n_maj)


def random_undersample(
    df: DataFrame, label: str = "Class", ratio: float = 1.0, seed: int = 42, id_col: str = "id", minority: int = 1
) -> DataFrame:
    """All minority rows plus min(int(n_min * ratio), n_maj) hash-chosen majority rows."""
    counts = class_counts_map(df, label)
    n_min = counts.get(minority, 0)
    n_maj = sum(v for k, v in counts.items() if k != minority)
    keep = undersample_size(n_min, n_maj, ratio)
    return df.filter((F.col(label) == minority) | ((F.col(label) != minority) & _first_others(df, minority, keep, label, seed, id_col)))


def _first_others(df: DataFrame, minority: int, n: int, label: str, seed: int, id_col: str):
    """Column: is the row among the first ``n`` rows in (draw, id) order of all classes but the minority?"""
    d = draw(seed, id_col)
    limits = rank_limits(df.filter(F.col(label) != minority), d, id_col, {None: [n]})
    return up_to(d, id_col, {None: limits[None][0]})


def cap_majority(
    df: DataFrame, label: str = "Class", max_rows: int = 100_000, keep_majority: int = 50_000, seed: int = 42, id_col: str = "id"
) -> DataFrame:
    """Boosting cap: above ``max_rows`` rows keep every minority row and at most ``keep_majority`` others."""
    counts = class_counts_map(df, label)
    if sum(counts.values()) <= max_rows:
        return df
    return df.filter((F.col(label) == 1) | ((F.col(label) != 1) & _first_others(df, 1, keep_majority, label, seed, id_col)))


def shuffled(df: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Rows in hashed random order (only where order is observable)."""
    return df.orderBy(uniform(seed, id_col), F.col(id_col))


def stratified_folds(df: DataFrame, n_folds: int = 3, label: str = "Class", seed: int = 42, id_col: str = "id", fold_col: str = "fold") -> DataFrame:
    """Stratified fold ids: each class, in (draw, id) order, is cut into ``n_folds`` stretches whose sizes differ by one at most."""
    counts = class_counts_map(df, label)
    ends = {c: [sum(n // n_folds + (j < n % n_folds) for j in range(f + 1)) for f in range(n_folds - 1)] for c, n in counts.items()}
    d = draw(seed, id_col)
    limits = rank_limits(df, d, id_col, ends, label)
    fold = F.lit(n_folds - 1)
    for f in reversed(range(n_folds - 1)):
        fold = F.when(up_to(d, id_col, {c: v[f] for c, v in limits.items()}, label), F.lit(f)).otherwise(fold)
    return df.withColumn(fold_col, fold.cast("int"))


def class_weight_map(df: DataFrame, label: str = "Class") -> dict:
    """{class: n / (n_classes * count_c)} over the classes present (one collected row per class)."""
    counts = class_counts_map(df, label)
    n, k = sum(counts.values()), len(counts)
    return {c: n / (k * cnt) for c, cnt in counts.items()}


def class_weights(df: DataFrame, label: str = "Class") -> DataFrame:
    """``label, count, weight`` with weight = n / (n_classes * count_c)."""
    counts = class_counts_map(df, label)
    w = class_weight_map(df, label) if counts else {}
    rows = [(c, counts[c], w[c]) for c in sorted(counts, key=lambda x: (x is None, x))]
    dtype = dict(df.dtypes)[label]
    return df.sparkSession.createDataFrame(rows, f"{label} {dtype}, count long, weight double")


def with_class_weights(df: DataFrame, label: str = "Class", weight_col: str = "weight") -> DataFrame:
    """Attach each row's class weight from a literal class -> weight map (no join)."""
    w = class_weight_map(df, label)
    m = F.create_map(*[x for c, v in w.items() for x in (F.lit(c), F.lit(float(v)))])
    return df.withColumn(weight_col, m[F.col(label)])


def smote_allocation(n_min: int, n_maj: int) -> tuple[int, int]:
    """(synthetic rows to make, slots per base row): base rows are filled in order, n_gen // n_min + 1 each."""
    n_gen = n_maj - n_min
    return n_gen, (n_gen // n_min + 1 if n_min else 0)


def smote(
    df: DataFrame,
    feature_cols,
    label: str = "Class",
    k_neighbors: int = 5,
    seed: int = 42,
    id_col: str = "id",
    minority: int = 1,
) -> DataFrame:
    """SMOTE oversampling of the minority class up to the majority count.

    Output: ``id, <features>, label, is_synthetic, base_id``.  Base row i (in id
    order) makes min(n_per, n_gen - i*n_per) samples x + alpha * (x_nn - x), the
    neighbour drawn uniformly from its k nearest minority rows and alpha in
    [0, 1), both hashed from (seed, base id, slot).  Synthetic ids are -(slot+1).
    Nothing to generate -> the input rows unchanged.
    """
    from txrisk.operators.knn import knn, vector

    feats = list(feature_cols)
    counts = class_counts_map(df, label)
    n_min = counts.get(minority, 0)
    n_maj = sum(v for c, v in counts.items() if c != minority)
    original = df.select(
        id_col, *feats, F.col(label), F.lit(False).alias("is_synthetic"), F.lit(None).cast("long").alias("base_id")
    )
    n_gen, n_per = smote_allocation(n_min, n_maj)
    if n_gen <= 0:
        return original
    k = min(k_neighbors, n_min - 1)
    if k < 1:
        raise ValueError("SMOTE needs at least two minority rows")
    mino = df.filter(F.col(label) == minority).select(id_col, vector(feats).alias("_x"))
    nb = knn(mino.select(id_col, *[F.col("_x")[i].alias(c) for i, c in enumerate(feats)]), feats, k, id_col=id_col)
    pos = attach_positions(mino, [id_col], key=id_col, pos_col="_mpos")  # positions on the ids only
    cnt = F.least(F.lit(n_per), F.greatest(F.lit(n_gen) - F.col("_mpos") * n_per, F.lit(0)))
    slots = pos.withColumn("_cnt", cnt).filter(F.col("_cnt") > 0).select(
        id_col, "_x", "_mpos", F.explode(F.sequence(F.lit(0), F.col("_cnt") - 1)).alias("_s")
    )
    slots = slots.withColumns(
        {
            "rank": (F.floor(uniform(seed, id_col, "_s", salt=1) * k) + 1).cast("int"),
            "_alpha": uniform(seed, id_col, "_s", salt=2),
        }
    )
    partner = nb.select(id_col, "rank", "nid").join(mino.select(F.col(id_col).alias("nid"), F.col("_x").alias("_nx")), "nid")
    synth = slots.join(partner, [id_col, "rank"])
    new = F.zip_with("_x", "_nx", lambda a, b: a + F.col("_alpha") * (b - a))
    synth = synth.select(
        (-(F.col("_mpos") * n_per + F.col("_s")) - 1).cast("long").alias(id_col),
        new.alias("_v"),
        F.col(id_col).alias("base_id"),
    )
    synth = synth.select(
        id_col,
        *[F.col("_v")[i].alias(c) for i, c in enumerate(feats)],
        F.lit(minority).cast(dict(df.dtypes)[label]).alias(label),
        F.lit(True).alias("is_synthetic"),
        "base_id",
    )
    return original.unionByName(synth)
