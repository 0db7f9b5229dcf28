"""Exact k-nearest neighbours within one set of rows (Euclidean, self excluded, ties by neighbour id).

Plan
----
1. Copies collapse: rows are grouped by their feature vector into distinct
   vectors with a multiplicity and a bounded *head* (the k+1 smallest member
   ids).  The head is built per (vector, salt) first, so a vector shared by a
   third of all rows is still spread over many tasks.  Copies are each other's
   nearest neighbours at distance 0, so a vector with more than k copies never
   needs any other vector.
2. Distinct vectors are numbered by their length and cut into tiles of exactly
   ``TILE`` vectors; a tile is one row.  Building a tile also finds, for every
   vector, the distance of its k-th neighbour inside the tile: an upper bound
   of the true one.
3. ``GROUP`` neighbouring tiles ask together.  The lengths of two vectors differ
   by no more than their distance, so a group only meets the tiles whose range
   of lengths is nearer than the largest bound of its vectors.  A task streams
   the tiles of one (group, stripe), nearest lengths first, and keeps k
   (distance, id) pairs per asking vector: its memory is one group, one tile
   and the pairs, at any size.
4. The lists of the stripes of a vector merge into one: k smallest (distance, id).
5. Rows expand the distance-0 copies and the neighbour vectors' heads and keep
   the k smallest (distance, id) pairs other than themselves.

There is one plan for every size.  Distances are summed column by column in
doubles, so they have the same bits in whatever tile two vectors meet.  Only
the first k vectors by (distance, smallest member id) can hold one of the k
nearest rows, since each of those vectors has a row at least as near.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.ordering import with_positions
from txrisk.session import checkpoint_dir

TILE = 4096  # distinct vectors a tile
GROUP = 4  # tiles that ask together
STRIPE = 8  # tiles a stripe at least
STRIPES = 32  # stripes a group at most: as many lists meet in a merge
_CHUNK = 256  # asking vectors a matrix product

_TILE_SCHEMA = "tile long, n int, low double, high double, reach double, ids binary, vecs binary, bounds binary"
_WORK_COLUMNS = ["part", "stripe", "gap", "n", "ids", "vecs", "bounds"]


def vector(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def distinct_vectors(df: DataFrame, id_col: str, vec_col: str, k: int, salts: int = 64) -> DataFrame:
    """``vid, vec, mult, head``: one row per distinct vector; vid = smallest member id."""
    keyed = df.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("vec")).withColumn("_vk", F.xxhash64("vec"))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    w = Window.partitionBy("_vk", "vec", "_salt").orderBy("_id")
    # the rank limit is applied before the shuffle too, so a task receives k + 1 ids per (vector, salt) and map task
    heads = salted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1)
    head = heads.groupBy("_vk", "vec").agg(F.slice(F.array_sort(F.collect_list("_id")), 1, k + 1).alias("head"))
    mult = keyed.groupBy("_vk", "vec").agg(F.count(F.lit(1)).alias("mult"))
    return head.join(mult, ["_vk", "vec"]).select(F.col("head")[0].alias("vid"), "_vk", "vec", "mult", "head")


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """Written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/txrisk-knn/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------------------
# numpy kernels (run inside tasks)
# ---------------------------------------------------------------------------


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of x's rows to q, summed in column order: the same bits however the rows are grouped."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        d = x[:, c] - q[c]
        total += d * d
    return np.sqrt(total)


class Nearest:
    """The k nearest (distance, id) pairs of some asking vectors, over all tiles shown so far."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, bounds: np.ndarray, k: int) -> None:
        self.ids, self.vecs, self.k = ids, vecs, k
        self.square = (vecs**2).sum(axis=1)
        self.bounds = bounds.copy()  # no neighbour wanted beyond
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)

    def show(self, xids: np.ndarray, xvecs: np.ndarray) -> None:
        xsquare = (xvecs**2).sum(axis=1)
        few = min(self.k + 1, len(xids))  # one more than k, as the asking vector may be among them
        # a bound on the rounding of the expanded squares |q|^2 + |x|^2 - 2qx
        error = 8.0 * (xvecs.shape[1] + 2) * np.finfo(np.float64).eps
        for s in range(0, len(self.ids), _CHUNK):
            e = min(s + _CHUNK, len(self.ids))
            square = self.square[s:e, None] + xsquare[None, :] - 2.0 * (self.vecs[s:e] @ xvecs.T)
            slack = error * (self.square[s:e] + xsquare.max())
            limit = self.bounds[s:e] ** 2 * (1 + 1e-12) + slack
            near = square <= limit[:, None]
            count = near.sum(axis=1)
            many = np.flatnonzero(count > 4 * few)
            if len(many):  # only the nearest ones of the tile can matter
                cut = np.partition(square[many], few - 1, axis=1)[:, few - 1] + 2 * slack[many]
                near[many] &= square[many] <= cut[:, None]
            for r in np.flatnonzero(count):
                at = np.flatnonzero(near[r])
                at = at[xids[at] != self.ids[s + r]]
                if len(at):
                    self._take(s + r, distances(self.vecs[s + r], xvecs[at]), xids[at])

    def _take(self, r: int, d: np.ndarray, i: np.ndarray) -> None:
        d, i = np.concatenate((self.found[r][0], d)), np.concatenate((self.found[r][1], i))
        order = np.lexsort((i, d))[: self.k]
        self.found[r] = d[order], i[order]
        if len(order) == self.k:
            self.bounds[r] = min(self.bounds[r], float(d[order[-1]]))


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _build_tile(k: int):
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        ids, mult = (rows.column(c).to_numpy().astype(np.int64) for c in ("vid", "mult"))
        vecs = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        length = rows.column("length").to_numpy()
        asking = mult <= k  # the others have k copies of their own
        bounds = np.full(len(ids), -1.0)  # -1: asks nothing
        if asking.any():
            own = Nearest(ids[asking], vecs[asking], np.full(int(asking.sum()), np.inf), k)
            own.show(ids, vecs)
            bounds[asking] = own.bounds
        data = {"tile": [key[0].as_py()], "n": [len(ids)], "low": [float(length.min())], "high": [float(length.max())], "reach": [float(bounds.max())]}
        data |= {"ids": [_bytes(ids)], "vecs": [_bytes(vecs)], "bounds": [_bytes(bounds)]}
        return pa.table(data, schema=_schema(_TILE_SCHEMA))

    return build


def tiles(dv: DataFrame, k: int) -> DataFrame:
    """Distinct vectors as tiles of ``TILE`` in order of length, with every vector's bound from its own tile."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    placed = with_positions(dv.select("vid", "vec", "mult", length.alias("length")), ["length", "vid"], pos_col="_at")
    return placed.withColumn("tile", F.floor(F.col("_at") / TILE)).groupBy("tile").applyInArrow(_build_tile(k), _TILE_SCHEMA)


def _search(k: int, dim: int):
    out = pa.schema([("vid", pa.int64()), ("wid", pa.int64()), ("dist", pa.float64())])

    def result(asked: Nearest | None) -> Iterator[pa.RecordBatch]:
        if asked is None:
            return
        sizes = [len(d) for d, _ in asked.found]
        if sum(sizes):
            cols = [np.repeat(asked.ids, sizes), np.concatenate([i for _, i in asked.found]), np.concatenate([d for d, _ in asked.found])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=out)

    def start(rows: list[dict]) -> Nearest:
        ids, bounds = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("ids", np.int64), ("bounds", np.float64)))
        vecs = np.concatenate([np.frombuffer(r["vecs"]).reshape(-1, dim) for r in rows])
        asking = bounds >= 0
        return Nearest(ids[asking], vecs[asking], bounds[asking], k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, asked = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["part"], row["stripe"]) != unit:
                    yield from result(asked)
                    unit, rows, asked = (row["part"], row["stripe"]), [], None
                if row["bounds"] is not None:  # the asking tiles are a unit's first rows
                    rows.append(row)
                    continue
                asked = asked or start(rows)
                if row["gap"] <= asked.bounds.max() * (1 + 1e-9):
                    asked.show(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"]).reshape(-1, dim))
        yield from result(asked)

    return run


def vector_neighbours(dv: DataFrame, k: int, dim: int) -> DataFrame:
    """``vid, nb``: the k nearest other distinct vectors as an array of (dist, wid), of each vector with at most k copies."""
    table = _stored(tiles(dv, k), "tiles")
    n = table.count()
    stripes = max(1, min(STRIPES, -(-n // STRIPE)))
    part = F.floor(F.col("tile") / GROUP)
    asking = table.filter("reach >= 0").withColumn("part", part)
    range_of = lambda m: F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))
    # (group, tile) pairs are numbers only: one for every GROUP * TILE by TILE distances, fewer after the bound
    groups = asking.groupBy("part").agg(F.min("low").alias("g_low"), F.max("high").alias("g_high"), F.max("reach").alias("g_reach"))
    pairs = groups.select("*", F.explode(range_of(n)).alias("tile")).join(table.select("tile", "low", "high"), "tile")
    pairs = pairs.withColumn("gap", F.greatest(F.lit(0.0), F.col("low") - F.col("g_high"), F.col("g_low") - F.col("high")))
    # lengths carry rounding of their own, relative to their size
    pairs = pairs.filter(F.col("gap") <= F.col("g_reach") * (1 + 1e-9) + F.greatest("high", "g_high") * 1e-9).select("part", "tile", "gap")
    none = F.lit(None).cast("binary")
    shown = pairs.join(table.select("tile", "n", "ids", "vecs"), "tile").withColumns({"stripe": F.pmod("tile", F.lit(stripes).cast("long")), "bounds": none})
    asks = asking.withColumns({"gap": F.lit(-1.0), "stripe": F.explode(range_of(stripes))})
    work = asks.select(*_WORK_COLUMNS).unionByName(shown.select(*_WORK_COLUMNS))
    units = max(1, -(-n // GROUP)) * stripes
    work = work.repartition(min(2 * units, 20_000), "part", "stripe").sortWithinPartitions("part", "stripe", "gap")
    lists = work.mapInArrow(_search(k, dim), "vid long, wid long, dist double")
    merged = F.slice(F.array_sort(F.collect_list(F.struct("dist", "wid"))), 1, k)  # at most k entries a stripe
    return lists.groupBy("vid").agg(merged.alias("nb"))


def knn(df: DataFrame, feature_cols: Sequence[str], k: int, id_col: str = "id") -> DataFrame:
    """``id, rank, nid, dist``: the k nearest other rows of each row (rank 1 = nearest).

    k is lowered to n - 1 when fewer rows exist.  Ordering is (distance, neighbour id).
    """
    base = df.select(F.col(id_col).cast("long").alias("_id"), vector(feature_cols).alias("_vec"))
    dv = _stored(distinct_vectors(base, "_id", "_vec", k), "vectors")
    n = dv.agg(F.sum("mult")).first()[0] or 0
    k = min(k, n - 1)
    if k < 1:
        raise ValueError("nearest neighbours need at least two rows")
    nb = vector_neighbours(dv, k, len(feature_cols)).select("vid", F.explode("nb").alias("w"))
    heads = dv.select(F.col("vid").alias("wid"), F.slice("head", 1, k + 1).alias("whead"))
    far = nb.select("vid", "w.wid", "w.dist").join(heads, "wid")
    far = far.select("vid", F.explode(F.transform("whead", lambda x: F.struct(F.col("dist").alias("d"), x.alias("i")))).alias("c"))
    far = far.groupBy("vid").agg(F.collect_list("c").alias("far"))  # at most k heads of k + 1
    near = F.transform("head", lambda x: F.struct(F.lit(0.0).alias("d"), x.alias("i")))
    cand = dv.join(far, "vid", "left").select("_vk", F.col("vec").alias("_vec"), F.array_sort(F.concat(near, F.coalesce("far", F.array().cast("array<struct<d:double,i:bigint>>")))).alias("cand"))
    rows = base.withColumn("_vk", F.xxhash64("_vec")).join(cand, ["_vk", "_vec"])
    picked = rows.select("_id", F.slice(F.filter("cand", lambda c: c["i"] != F.col("_id")), 1, k).alias("nb"))
    out = picked.select("_id", F.posexplode("nb").alias("_r", "c"))
    return out.select(
        F.col("_id").alias(id_col),
        (F.col("_r") + 1).cast("int").alias("rank"),
        F.col("c")["i"].alias("nid"),
        F.col("c")["d"].alias("dist"),
    )
