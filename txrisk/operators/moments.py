"""Moments of many columns in one pass over wide rows.

Every task reads its rows in Arrow batches, column by column, and keeps the count, mean and sum of squares about the
mean of each column per (group, label); batches merge by Chan's formula.  A task hands on one row per (group, label,
feature), so what is shuffled does not grow with the rows.  Rows are never unpivoted.  Moments over all labels, and
the co-moment of a feature with the label, follow exactly from those parts:

    sum over parts of n (mean_part - mean)(label of the part - mean of labels)

so ``label`` and the groups must have few distinct values.  Nulls are left out column by column, as SQL aggregates do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAT_RELATIVE = 1e-10


def _add(held: tuple | None, x: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sum of squares of each column of ``x``, merged with those held so far."""
    n = present.sum(axis=0).astype(np.float64)
    some = np.maximum(n, 1)
    mean = np.where(present, x, 0.0).sum(axis=0) / some
    m2 = (np.where(present, x - mean, 0.0) ** 2).sum(axis=0)
    if held is None:
        return n, mean, m2
    n0, mean0, m20 = held
    both = np.maximum(n0 + n, 1)
    apart = mean - mean0
    return n0 + n, np.where(n > 0, mean0 + apart * n / both, mean0), m20 + m2 + np.where((n0 > 0) & (n > 0), apart * apart * n0 * n / both, 0.0)


def _parts(columns: list[str], keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        types = None
        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
            present = np.column_stack([b.column(c).is_valid().to_numpy(zero_copy_only=False) for c in columns])
            code, values = np.zeros(b.num_rows, np.int64), []
            for k in keys:
                d = b.column(k).dictionary_encode("encode")
                code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                values.append(d.dictionary.to_pylist())
            for c in np.unique(code):
                at, rest, key = np.flatnonzero(code == c), int(c), []
                for v in reversed(values):
                    rest, i = divmod(rest, len(v) + 1)
                    key.append(v[i])
                key = tuple(reversed(key))
                held[key] = _add(held.get(key), x[at], present[at])
        if held:
            d = len(columns)
            cols = [pa.array([key[i] for key in held for _ in range(d)], t) for i, t in enumerate(types)]
            n, mean, m2 = (np.concatenate([v[i] for v in held.values()]) for i in range(3))
            cols += [pa.array(columns * len(held)), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(m2)]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "feature", "n", "mean", "m2"])

    return run


def label_moments(df: DataFrame, columns: Sequence[str], label: str | Column, groups: Sequence[Column] = ()) -> DataFrame:
    """``<groups>, label, feature, n, mean, m2``: per task, group and label, of the non-null values of each column."""
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(*groups, label.cast("double").alias("label"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    keys = rows.columns[: -len(columns)]
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[: len(keys)]] + ["feature string", "n long", "mean double", "m2 double"])
    out = rows.mapInArrow(_parts([f"_x{i}" for i in range(len(columns))], keys), schema)
    names = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(f"_x{i}"), F.lit(c))])
    return out.filter("n > 0").withColumn("feature", names[F.col("feature")])


def _merged(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Each part with the count and mean over all parts of its group and feature; a window holds (tasks x labels) rows at most."""
    w = Window.partitionBy(*groups, "feature")
    n = F.sum("n").over(w)
    return parts.withColumns({"_n": n, "_mean": F.sum(F.col("n") * F.col("mean")).over(w) / n, "_lmean": F.sum(F.col("n") * F.col("label")).over(w) / n})


def moments(parts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """``<groups>, feature, n, mean, std``: over all labels; std is the sample deviation (null for one value)."""
    apart = F.col("mean") - F.col("_mean")
    out = _merged(parts, groups).groupBy(*groups, "feature").agg(
        F.max("_n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("_m2")
    )
    return out.select(*groups, "feature", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("_m2") / (F.col("n") - 1))).alias("std"))


def label_correlation(parts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """``<groups>, feature, correlation``: Pearson's with the label; 0 where either is (numerically) constant."""
    dx, dy = F.col("mean") - F.col("_mean"), F.col("label") - F.col("_lmean")
    out = _merged(parts.filter(F.col("label").isNotNull()), groups).groupBy(*groups, "feature").agg(
        F.max("_mean").alias("mx"), F.max("_lmean").alias("my"), F.max("_n").alias("n"),
        F.sum(F.col("m2") + F.col("n") * dx * dx).alias("sxx"), F.sum(F.col("n") * dy * dy).alias("syy"), F.sum(F.col("n") * dx * dy).alias("sxy"),
    )
    sx, sy = F.sqrt(F.col("sxx") / F.col("n")), F.sqrt(F.col("syy") / F.col("n"))
    flat = lambda s, m: s <= F.lit(FLAT_RELATIVE) * F.greatest(F.lit(1.0), F.abs(m))
    r = F.try_divide(F.col("sxy") / F.col("n"), sx * sy)
    return out.select(*groups, "feature", F.when(flat(sx, F.col("mx")) | flat(sy, F.col("my")), F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0))).alias("correlation"))
