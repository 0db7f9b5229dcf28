"""Hard negatives by inner product, with coordinate pruning inside length buckets.

Vectors become integers (floor(256 x)).  Rows are put into buckets of similar length and each bucket into tiles of
some ``TILE`` rows; a tile stores its matrix and, for every coordinate, the list of its rows sorted by the value of
that coordinate on the unit sphere.  Anchors are put into blocks of some ``BLOCK``.  A unit of work is one block of
anchors against one stripe of tiles, read longest first.  For each anchor the unit holds its best rows so far, so
its lower limit on the score rises; a tile whose longest vector cannot reach the limit is skipped, and in the
others the limit is an angle, the angle gives a feasible range of values for each of the anchor's focus
coordinates (its largest), the ranges are found in the sorted lists by bisection, and only the rows in all
of them are multiplied out.

Two passes: the first finds each anchor's positives (best rows of its label), the second, for each positive,
the best rows of other labels inside the window of scores that the positive sets.  Both end in a top-k over
the stripes.  Anchors are a stated query set; tiles go to every block of anchors, rows are never paired.

Defined cases: rows with a null vec_id, label or vector, with a null or non-finite component, with a component of 2^23
or more, or with whole numbers whose squares sum to 2^55 or more (100 times their scores would not fit a long) take
no part.  Rows equal in vec_id,
label and integer vector are one row; rows that share a vec_id and differ are rows of their own, and none of them is
a partner of another.  Only vectors of one dimension are compared; empty vectors have score 0.  An anchor without
positives, and a positive whose window holds no row, give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import staged

TILE = 1024  # rows a tile, about
BLOCK = 2048  # anchors a block, about
STRIPE = 8  # tiles a stripe at least
STRIPES = 64  # stripes a block at most, so that an anchor has at most 64 lists to merge
FOCUS = 4  # focus coordinates an anchor
_BUCKETS_PER_OCTAVE = 4  # of the squared length
_ROUNDING = 1e-7  # widens angles and ranges; it lets rows through to the exact check, never the other way

_NONE = -(1 << 62)  # no lower limit

_TILE_SCHEMA = "dim int, deal long, ord double, n int, ids binary, keys binary, labels binary, vectors binary, lists binary"
_BLOCK_SCHEMA = "dim int, block long, n int, ids binary, keys binary, labels binary, vectors binary, marks binary"


def integer_rows(df: DataFrame, relabel_every: int = 7, classes: int = 10) -> DataFrame:
    """``id, key, label, vec, norm``: distinct rows that take part, integer vectors as array<long>."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(256) * v.cast("double")))
    ok = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float(2**23))))  # NaN is above all
    own = df.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding"))
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(ok)
    label = F.when(F.pmod("id", F.lit(relabel_every)) == 0, F.pmod(F.col("label") + 1, F.lit(classes))).otherwise(F.col("label"))
    rows = own.select("id", label.alias("label"), x.alias("vec"))
    rows = rows.withColumn("norm", F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))).filter(F.col("norm") < F.lit(float(2**55)))
    return rows.withColumn("key", F.xxhash64("id", "label", "vec")).groupBy("id", "key", "label", "vec", "norm").agg(F.lit(1).alias("_one")).drop("_one")


def _matrix(rows: pa.Table, dim: int) -> np.ndarray:
    return rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), dim)


def _pack(a: np.ndarray) -> list[bytes]:
    """The bytes of a whole-number array in its narrowest type."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return [np.ascontiguousarray(a, kind).tobytes()]


def _unpack(data: bytes, *shape: int) -> np.ndarray:
    size = int(np.prod(shape))
    return np.frombuffer(data, f"i{len(data) // size}" if size else "i2").astype(np.int64).reshape(shape)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def _on_sphere(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    return x / np.maximum(length, 1e-300)[:, None]


def _build_tile(key: tuple, rows: pa.Table) -> pa.Table:
    """One row: ids, keys, labels and vectors, and for each coordinate the rows' order by its value on the unit sphere."""
    dim, bucket, chunk = (k.as_py() for k in key)
    x = _matrix(rows, dim)
    length = _lengths(x)
    own = {c: _pack(rows.column(n).to_numpy()) for c, n in (("ids", "id"), ("keys", "key"), ("labels", "label"))}
    lists = np.argsort(_on_sphere(x, length), axis=0, kind="stable").T
    data = {"dim": [dim], "deal": [chunk + 5 * bucket], "ord": [-float(length.max())], "n": [len(rows)], **own, "vectors": _pack(x), "lists": _pack(lists)}
    return pa.table(data, schema=_arrow(_TILE_SCHEMA))


def tiles(rows: DataFrame) -> DataFrame:
    """The index: rows dealt into length buckets, each into tiles by hash."""
    bucket = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * _BUCKETS_PER_OCTAVE)).otherwise(F.lit(-1)).cast("long")
    placed = rows.withColumns({"bucket": bucket, "_dim": F.size("vec")})
    sizes = placed.groupBy("_dim", "bucket").agg(F.count(F.lit(1)).alias("m"))  # at most 221 buckets a dimension
    placed = placed.join(sizes, ["_dim", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("key"), F.ceil(F.col("m") / TILE)))
    return placed.groupBy("_dim", "bucket", "chunk").applyInArrow(_build_tile, _TILE_SCHEMA)


def _build_block(key: tuple, rows: pa.Table) -> pa.Table:
    dim, block = (k.as_py() for k in key)
    own = {c: _pack(rows.column(n).to_numpy()) for c, n in (("ids", "id"), ("keys", "key"), ("labels", "label"))}
    marks = rows.column("marks").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    data = {"dim": [dim], "block": [block], "n": [len(rows)], **own, "vectors": _pack(_matrix(rows, dim)), "marks": _pack(marks)}
    return pa.table(data, schema=_arrow(_BLOCK_SCHEMA))


def _blocks(anchors: DataFrame, many: int) -> DataFrame:
    """Anchors in ``many`` blocks a dimension; ``marks`` holds a lower and an upper limit for each slot."""
    dealt = anchors.withColumns({"_dim": F.size("vec"), "_block": F.pmod(F.xxhash64("key"), F.lit(many))})
    return dealt.groupBy("_dim", "_block").applyInArrow(_build_block, _BLOCK_SCHEMA)


class _Tile:
    def __init__(self, row: dict) -> None:
        n, dim = row["n"], row["dim"]
        self.ids, self.keys, self.labels = (_unpack(row[c], n) for c in ("ids", "keys", "labels"))
        self.x = _unpack(row["vectors"], n, dim)
        self.lists = _unpack(row["lists"], dim, n)
        length = _lengths(self.x)
        self.longest, self.shortest = float(length.max()), float(length.min())
        self.unit = _on_sphere(self.x, length)
        self.sorted: dict[int, np.ndarray] = {}
        self.as_float = self.x.astype(np.float64)

    def feasible(self, unit: np.ndarray, length: float, focus: np.ndarray, limit: int) -> np.ndarray | None:
        """Places of the rows that may score at least ``limit``; None for all of them."""
        if limit == _NONE or not len(focus):
            return None
        reach = length * (self.longest if limit > 0 else self.shortest)
        if reach == 0:  # every score is 0, or may be if a zero vector is among longer ones
            return None if limit <= 0 else np.zeros(0, np.int64)
        cosine = limit / reach - _ROUNDING
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine <= -1:
            return None
        width = np.arccos(cosine)
        at = np.arccos(np.clip(unit[focus], -1, 1))
        low, high = np.cos(np.minimum(np.pi, at + width)) - _ROUNDING, np.cos(np.maximum(0, at - width)) + _ROUNDING
        spans = []
        for f, a, b in zip(focus.tolist(), low, high, strict=True):
            values = self.sorted.get(f)
            if values is None:
                values = self.sorted[f] = self.unit[self.lists[f], f]
            spans.append((int(values.searchsorted(a)), int(values.searchsorted(b, side="right"))))
        k = min(range(len(spans)), key=lambda i: spans[i][1] - spans[i][0])
        if spans[k][1] - spans[k][0] == len(self.ids):
            return None
        rows = self.lists[focus[k], spans[k][0] : spans[k][1]]
        for i, f in enumerate(focus.tolist()):
            if i != k and len(rows):
                v = self.unit[rows, f]
                rows = rows[(v >= low[i]) & (v <= high[i])]
        return rows


def _best(score: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(score) > 4 * k:  # a cheap cut first, ties of the k-th kept
        cut = np.partition(score, len(score) - k)[len(score) - k]
        near = score >= cut
        score, ids, keys = score[near], ids[near], keys[near]
    order = np.lexsort((keys, ids, -score))[:k]
    return score[order], ids[order], keys[order]


def _search(positive: bool, slots: int, k: int):
    """Anchors of one unit against its tiles; yields each anchor's ``k`` best rows in each of its windows."""
    out_schema = pa.schema([(c, pa.int64()) for c in ("aid", "akey", "slot", "id", "key", "score")])

    def result(state) -> Iterator[pa.RecordBatch]:
        if state is None:
            return
        cols: list[list[np.ndarray]] = [[] for _ in out_schema]
        for a, own in enumerate(state["best"]):
            for j, (score, ids, keys) in own.items():
                full = lambda v, n=len(score): np.full(n, v, np.int64)
                for c, v in zip(cols, (full(state["ids"][a]), full(state["keys"][a]), full(j), ids, keys, score), strict=True):
                    c.append(v)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], schema=out_schema)

    def anchors(row: dict) -> dict:
        n, dim = row["n"], row["dim"]
        x = _unpack(row["vectors"], n, dim)
        length = _lengths(x)
        unit = _on_sphere(x, length)
        ints = {c: _unpack(row[c], n) for c in ("ids", "keys", "labels")}
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        return {**ints, "x": x, "length": length, "unit": unit, "focus": focus, "marks": _unpack(row["marks"], n, slots, 2), "best": [{} for _ in range(n)]}

    def limit(own: dict, marks: np.ndarray, j: int) -> int:
        """What a row must score to enter list j: the window's lower end, or the k-th best so far."""
        low = _NONE if positive else int(marks[j, 0])
        held = own.get(j)
        return max(low, int(held[0][-1])) if held is not None and len(held[0]) == k else low

    def compare(s: dict, t: _Tile) -> None:
        for a in range(len(s["ids"])):
            own, marks = s["best"][a], s["marks"][a]
            wanted = [j for j in range(slots) if positive or marks[j, 0] <= marks[j, 1]]
            if not wanted:
                continue
            rows = t.feasible(s["unit"][a], float(s["length"][a]), s["focus"][a], min(limit(own, marks, j) for j in wanted))
            if rows is not None and not len(rows):
                continue
            pick = slice(None) if rows is None else rows
            if s["length"][a] * t.longest < 2.0**52:  # every partial sum is a whole number that a double holds
                score = (t.as_float[pick] @ s["x"][a].astype(np.float64)).astype(np.int64)
            else:
                score = t.x[pick] @ s["x"][a]
            ids, keys = t.ids[pick], t.keys[pick]
            same = t.labels[pick] == s["labels"][a]
            fits = (same & (ids != s["ids"][a])) if positive else ~same & (ids != s["ids"][a])
            for j in wanted:
                now = fits & (score >= limit(own, marks, j))
                if not positive:
                    now &= score <= marks[j, 1]
                if now.any():
                    held = own.get(j)
                    parts = (score[now], ids[now], keys[now])
                    own[j] = _best(*(parts if held is None else tuple(np.concatenate(p) for p in zip(held, parts, strict=True))), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, unit = None, None
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if (row["dim"], row["unit"]) != unit:
                    yield from result(state)
                    state, unit = None, (row["dim"], row["unit"])
                if row["marks"] is not None:  # a unit's anchors are its first row
                    state = anchors(row)
                elif state is not None:
                    compare(state, _Tile(row))
        yield from result(state)

    return run


def _pass(index: DataFrame, stripes: int, blocks: DataFrame, many: int, positive: bool, slots: int, k: int, tag: str) -> DataFrame:
    """``aid, akey, slot, id, key, score, rank``: the k best rows of each anchor and slot over all stripes."""
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cols = ["dim", "block", "stripe", "ord", "n", "ids", "keys", "labels", "vectors", "lists", "marks"]
    tile = index.withColumn("stripe", F.pmod(F.col("deal"), F.lit(stripes).cast("long"))).select("*", spread(many).alias("block"), F.lit(None).cast("binary").alias("marks"))
    block = blocks.select("*", spread(stripes).alias("stripe"), F.lit(float("-inf")).alias("ord"), F.lit(None).cast("binary").alias("lists"))
    work = tile.select(*cols).unionByName(block.select(*cols)).withColumn("unit", F.col("block") * stripes + F.col("stripe"))
    # a unit's anchors come first, then its tiles, those with the longest vectors first
    work = work.repartition(min(2 * many * stripes, 20_000), "dim", "unit").sortWithinPartitions("dim", "unit", "ord")
    found = staged(work.mapInArrow(_search(positive, slots, k), "aid long, akey long, slot long, id long, key long, score long"), tag, batch_rows=4)
    best = Window.partitionBy("aid", "akey", "slot").orderBy(F.col("score").desc(), "id", "key")  # at most k rows a stripe
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low_pct: int = 30, high_pct: int = 90, relabel_every: int = 7, classes: int = 10
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive."""
    rows = staged(integer_rows(vectors, relabel_every, classes), "vectors")
    index = staged(tiles(rows), "tiles")
    anchors = rows.filter(F.pmod("id", F.lit(anchor_every)) == 0)
    many, stripes = max(1, -(-anchors.count() // BLOCK)), max(1, min(STRIPES, -(-index.count() // STRIPE)))
    first = _pass(index, stripes, _blocks(anchors.withColumn("marks", F.array_repeat(F.lit(0).cast("long"), 2)), many), many, True, 1, positives, "positives")
    first = first.select("aid", "akey", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    first = staged(first, "positive-lists")
    # the whole scores s with low * p <= 100 * s <= high * p; a slot without a positive is an empty window
    ends = first.select("aid", "akey", "slot", (-_floor_div(f"-positive_score * {low_pct}", 100)).alias("lo"), _floor_div(f"positive_score * {high_pct}", 100).alias("hi"))
    held = ends.groupBy("aid", "akey").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.array("lo", "hi")))).alias("m"))  # at most `positives` entries
    empty = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))
    slots = F.sequence(F.lit(0).cast("long"), F.lit(positives - 1).cast("long"))
    marks = F.flatten(F.transform(slots, lambda j: F.coalesce(F.try_element_at("m", j), empty)))
    asked = anchors.join(held.select(F.col("aid").alias("id"), F.col("akey").alias("key"), marks.alias("marks")), ["id", "key"])
    second = _pass(index, stripes, _blocks(asked, many), many, False, positives, negatives, "negatives")
    out = second.select("aid", "akey", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(first, ["aid", "akey", "slot"])
    return out.select(F.col("aid").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _floor_div(a: str, b: int) -> Column:
    """The largest whole number not above a / b, in longs."""
    return F.expr(f"(({a}) - pmod({a}, {b}L)) div {b}L")


#: The same rows in SQL, at the default parameters (but for the bounds on the size of components).
ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS aid, a.label AS al, b.vec_id AS bid, b.label AS bl, list_dot_product(a.q, b.q)::BIGINT AS s
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY s DESC, bid) AS r FROM s WHERE al = bl) WHERE r <= 5),
n AS (SELECT p.aid, p.bid AS pid, p.s AS ps, s.bid AS nid, s.s AS ns,
    row_number() OVER (PARTITION BY p.aid, p.bid ORDER BY s.s DESC, s.bid) AS rank
  FROM p JOIN s ON p.aid = s.aid AND s.bl <> s.al AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT aid AS anchor_id, pid AS positive_id, rank::INT AS rank, nid AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE rank <= 10
"""
