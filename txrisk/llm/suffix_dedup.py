"""Removal of repeated passages with a column-wise collection suffix structure.

A byte goes if a 200-byte string covering it also starts anywhere else, in the same document or another;
strings are judged on the input, and never cross documents.

Building one suffix structure over all texts would take one round per byte of the longest document, so the
collection is first cut, without loss, into short aligned documents:

* Every 200-byte window picks an anchor: its smallest 64-byte string by hash, the leftmost of equals.  Equal
  windows pick equal anchors at equal offsets.  Successive windows with one anchor form a segment of at most
  336 bytes, so equal windows only occur in segments with equal anchors, and at equal columns when segments
  are laid over each other at their anchors.
* Segments whose anchor is found once hold no repeated window.  Equal segments are one, with a count.
* The segments of one anchor form a collection and its documents are inserted column-wise, right to left: each round
  takes one symbol of every document (in the order of the suffixes to its right this column is the collection's
  Burrows-Wheeler transform), a stable sort by symbol gives the order of the suffixes that begin here, and the
  common prefixes are updated by range minima.  Neighbours with a common prefix of 200 bytes or more repeat.
  As equal windows share a column, suffixes of different columns need not be merged with each other.

The columns are scanned one after another like the files of the external method, but in memory, because the
collections are small: a task takes ``batch_segments`` of them at a time, and an anchor with more than
``group_segments`` different segments is split.  The different windows of a split anchor's parts are
matched across the parts by their fingerprints, so nothing is lost.

Defined cases: null and short texts have nothing to remove; rows are told apart by (doc_id, text), and rows
equal in both are occurrences of each other; null ids are allowed; an empty table gives no rows; other columns
are ignored.  In kept texts, a character that lost some of its bytes goes as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from txrisk.llm.common import covered, lean, multiply_mod_hash, runs, staged, texts

LENGTH = 200
ANCHOR = 64
_POS_BITS = 20
_PIECE = 1 << 19


def anchor_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the string of ``size`` (a power of two) bytes at each place."""
    h, k = raw.astype(np.uint64) + np.uint64(1), 1
    while k < size:
        h = h[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k * k) + h[k:]
        k *= 2
    return multiply_mod_hash(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    rest = width - k
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(raw: np.ndarray, bounds: list[tuple[int, int]], length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, length, anchor's offset) of the segments of the pieces [a, b) of raw."""
    none = np.zeros(0, np.int64)
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in bounds] or [none])
    if not len(starts):
        return none, none, none, none
    h = anchor_hashes(raw, size)
    low = np.uint64((1 << _POS_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    best = sliding_min(key, length - size + 1)[starts]
    at = (best & low).astype(np.int64)
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    return h[at[new]].view(np.int64), first, last - first + length, at[new] - first


def _pieces(b: pa.RecordBatch, length: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Texts in buffers of at most 2^20 bytes: ([(row, offset in the text, length)], bytes).  Pieces overlap by length - 1."""
    rows, parts, size = [], [], 0
    for r, t in enumerate(texts(b)):
        for o in range(0, max(1, len(t) - length + 1), _PIECE - length + 1):
            p = t[o : o + _PIECE]
            if size + len(p) > _PIECE and rows:
                yield rows, b"".join(parts)
                rows, parts, size = [], [], 0
            rows.append((r, o, len(p)))
            parts.append(p)
            size += len(p)
    if rows:
        yield rows, b"".join(parts)


def _anchors(length: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, buf in _pieces(b, length):
                raw = np.frombuffer(buf, np.uint8)
                ends = np.cumsum([n for _, _, n in rows])
                begins = ends - [n for _, _, n in rows]
                h, first, n, left = segments(raw, list(zip(begins.tolist(), ends.tolist(), strict=True)), length, size)
                if not len(h):
                    continue
                piece = np.searchsorted(ends, first, side="right")
                start = first - begins[piece] + np.array([o for _, o, _ in rows])[piece]
                cut = np.searchsorted(piece, np.arange(len(rows) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, t)) for v, t in ((h, pa.int64()), (start, pa.int64()), (n, pa.int32()), (left, pa.int32()))]
                at = pa.array([r for r, _, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), *lists], ["k1", "k2", "h", "start", "n", "left_n"])

    return lean(run)


@lean
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per segment to compare; its bytes go along the first time this task meets them."""
    seen: set[int] = set()
    for b in batches:
        rows, hs, gs, starts, lefts, body, size = [], [], [], [], [], [], 0
        for r, (t, own) in enumerate(zip(texts(b), b.column("own"), strict=True)):
            for s in own.as_py():
                part = t[s["start"] : s["start"] + s["n"]]
                g = xxhash.xxh3_64_intdigest(part, seed=s["left_n"]) - (1 << 63)
                key = (s["h"] * 0x9E3779B97F4A7C15 ^ g) & (1 << 64) - 1
                rows.append(r)
                hs.append(s["h"])
                gs.append(g)
                starts.append(s["start"])
                lefts.append(s["left_n"])
                body.append(None if key in seen else part)
                size += 0 if key in seen else len(part)
                seen.add(key)
            if len(seen) > 200_000:  # only saves sending the same bytes again
                seen.clear()
            if size > 8 << 20 or r + 1 == b.num_rows:
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), pa.array(hs, pa.int64()), pa.array(gs, pa.int64()), pa.array(starts, pa.int64()), pa.array(lefts, pa.int32()), pa.array(body, pa.binary())], ["k1", "k2", "h", "g", "start", "left_n", "body"])
                rows, hs, gs, starts, lefts, body, size = [], [], [], [], [], [], 0


def repeated_windows(parts: list[bytes], lefts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Column-wise insertion: mask[i, w] tells whether window w of segment i occurs again.

    The segments lie over each other with their anchors in one column; ``counts`` are their occurrences.
    """
    n, before = len(parts), int(lefts.max())
    size = np.array([len(p) for p in parts])
    first = before - lefts  # column of a segment's first byte
    end = first + size
    width = int(end.max())
    text = np.zeros((n, width), np.uint8)
    for i, p in enumerate(parts):
        text[i, first[i] : end[i]] = np.frombuffer(p, np.uint8)
    text = np.ascontiguousarray(text.T)
    mask = np.zeros((n, int((size - length).max()) + 1), bool)
    joins = np.argsort(-end, kind="stable")  # documents by the column where they join
    joined = 0
    order = np.zeros(0, np.int64)  # documents in the order of their suffixes from the column to the right
    common = np.zeros(0, np.int16)  # common prefix with the one before
    many = counts >= 2
    for x in range(width - 1, -1, -1):
        stay = first[order] <= x
        if not stay.all():
            kept = np.flatnonzero(stay)
            order = order[kept]
            common = np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate(([0], kept[:-1] + 1))) if len(kept) else common[:0]
        k = joined
        while joined < n and end[joins[joined]] == x + 1:
            joined += 1
        if joined > k:  # empty suffixes sort first
            order = np.concatenate((joins[k:joined], order))
            common = np.concatenate((np.zeros(joined - k, np.int16), common))
            if len(common) > joined - k:
                common[joined - k] = 0
        if not len(order):
            continue
        bwt = text[x][order]
        sort = np.argsort(bwt, kind="stable")
        least = np.minimum.reduceat(np.append(common, np.int16(0)), sort + 1)
        order, bwt = order[sort], bwt[sort]
        common = np.zeros(len(order), np.int16)
        common[1:] = np.where(bwt[1:] == bwt[:-1], least[:-1] + 1, 0)
        if x <= before:
            long = common >= length
            again = long | np.append(long[1:], False) | many[order]
            again &= x + length <= end[order]
            hit = order[again]
            mask[hit, x - first[hit]] = True
    return mask


def _compare(length: int, batch_segments: int):
    """Rows (h, g, ranges of repeated windows, and for split anchors the fingerprints of their different windows)."""

    def finish(rows: list[dict]) -> pa.RecordBatch:
        mask = repeated_windows([r["body"] for r in rows], np.array([r["left_n"] for r in rows]), np.array([r["n"] for r in rows]), length)
        none = np.zeros(0, np.int64)
        ranges, fps, places, owner, matched = [], [none], [none], [none], [np.zeros(0, bool)]
        for k, (r, m) in enumerate(zip(rows, mask, strict=True)):
            own = m[: len(r["body"]) - length + 1]
            s, e = runs(own)
            ranges.append(np.stack([s, e], 1).ravel())
            if r["splits"] > 1:
                body, seed = r["body"], r["left_n"] + (1 << 20)
                fps.append(np.fromiter((xxhash.xxh3_64_intdigest(body[i : i + length], seed=seed - i) - (1 << 63) for i in range(len(own))), np.int64, len(own)))
                places.append(np.arange(len(own)))
                owner.append(np.full(len(own), k))
                matched.append(own)
        fp, place, row, match = (np.concatenate(v) for v in (fps, places, owner, matched))
        if len(fp):  # of the windows matched here one stands for all
            h = np.array([r["h"] for r in rows], np.int64)[row]
            order = np.lexsort((np.arange(len(fp)), fp, h))
            new = np.append(True, (np.diff(h[order]) != 0) | (np.diff(fp[order]) != 0))
            send = ~match
            send[order[new]] = True
            fp, place, row = fp[send], place[send], row[send]
        cut = pa.array(np.searchsorted(row, np.arange(len(rows) + 1)), pa.int32())
        cols = [pa.array([r["h"] for r in rows], pa.int64()), pa.array([r["g"] for r in rows], pa.int64()), pa.array(ranges, pa.list_(pa.int64()))]
        cols += [pa.ListArray.from_arrays(cut, pa.array(v, pa.int64())) for v in (fp, place)]
        return pa.RecordBatch.from_arrays(cols, ["h", "g", "ranges", "fps", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if len(wait) >= batch_segments and (row["h"], row["part"]) != (wait[-1]["h"], wait[-1]["part"]):
                    yield finish(wait)
                    wait = []
                if wait and (row["h"], row["g"]) == (wait[-1]["h"], wait[-1]["g"]):
                    continue  # another task sent the same bytes
                wait.append(row)
        if wait:
            yield finish(wait)

    return lean(run)


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t, spans in zip(texts(b), b.column("spans").to_pylist(), strict=True):
                left, n_spans = t, 0
                if spans:
                    a = np.array([(s["a"], s["b"]) for s in spans], np.int64)
                    gone = covered(a[:, 0], a[:, 1] - a[:, 0] + length - 1, len(t))
                    n_spans = len(runs(gone)[0])
                    left = np.frombuffer(t, np.uint8)[~gone].tobytes()
                out.append((len(t), len(t) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            names = [c for c in b.schema.names if c != "spans"]
            cols = [b.column(c) for c in names] + [pa.array([o[i] for o in out], pa.int64()) for i in range(3)] + [pa.array([o[i] for o in out], pa.string()) for i in (3, 4)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return lean(run)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group_segments: int = 4096, batch_segments: int = 4096, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns ``keep`` with n_bytes, n_removed, n_spans, kept_sha256, and kept_text if ``text`` is kept."""
    own = [c for c in keep if c != "text"]
    src = docs.select(*[F.col(c).alias(f"k_{c}") for c in own], F.xxhash64("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), F.col("text").cast("string").alias("text"))
    lists = "k1 long, k2 long, h array<long>, start array<long>, n array<int>, left_n array<int>"
    cuts = staged(src.select("k1", "k2", "text").mapInArrow(_anchors(length, anchor), lists), "anchors", batch_rows=512)
    # anchors found more than once, and their segments
    twice = cuts.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    twice = staged(twice, "twice")  # as a table of its own, so that the join can split the rows of a very common anchor
    every = cuts.select("k1", "k2", F.explode(F.arrays_zip("h", "start", "n", "left_n")).alias("s")).select("k1", "k2", "s.*")
    some = every.join(twice, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "start", "n", "left_n")).alias("own"))  # rows equal in id and text have one list
    with_text = src.select("k1", "k2", "text").join(some, ["k1", "k2"]).select("k1", "k2", "text", "own")
    found = staged(with_text.mapInArrow(_extract, "k1 long, k2 long, h long, g long, start long, left_n int, body binary"), "segments", batch_rows=256)
    # different segments with their number of occurrences; an anchor with too many is split by the segment's hash
    kinds = found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"))
    splits = kinds.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(group_segments)).cast("int").alias("splits"))
    body = found.filter("body IS NOT NULL").select("h", "g", "left_n", "body")
    ready = body.join(kinds, ["h", "g"]).join(splits, "h").withColumn("part", F.pmod("g", "splits").cast("int"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ready = ready.repartition(n, "h", "part").sortWithinPartitions("h", "part", "g").select("h", "g", "part", "left_n", "body", "n", "splits")
    compared = staged(ready.mapInArrow(_compare(length, batch_segments), "h long, g long, ranges array<long>, fps array<long>, places array<long>"), "compared", batch_rows=1024)
    # windows of split anchors that match a window in another part (a part sends a window that repeats within it once)
    open_ = compared.filter(F.size("fps") > 0).select("h", "g", F.explode(F.arrays_zip("fps", "places")).alias("w")).select("h", "g", "w.fps", "w.places")
    met = open_.groupBy("h", "fps").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", "fps")
    across = open_.join(met, ["h", "fps"], "left_semi").select("h", "g", F.col("places").alias("a"), (F.col("places") + 1).alias("b"))
    pair = F.transform(F.sequence(F.lit(0), (F.size("ranges") / 2 - 1).cast("int")), lambda i: F.struct(F.element_at("ranges", 2 * i + 1).alias("a"), F.element_at("ranges", 2 * i + 2).alias("b")))
    inside = compared.filter(F.size("ranges") > 0).select("h", "g", F.explode(pair).alias("r")).select("h", "g", "r.a", "r.b")
    spans = found.select("k1", "k2", "h", "g", "start").join(inside.union(across), ["h", "g"])
    spans = spans.select("k1", "k2", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).alias("s"))
    spans = spans.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))
    whole = src.join(spans, ["k1", "k2"], "left")
    names = [f"k_{c}" for c in own] + ["text", "spans"]
    fields = [f for f in whole.select(*names).schema.fields if f.name != "spans"]
    fields += [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [StructField(c, StringType()) for c in ("kept_sha256", "kept_text")]
    out = whole.select(*names).mapInArrow(_cut(length, "text" in keep), StructType(fields))
    tail = ["kept_text"] if "text" in keep else []
    return out.select(*[F.col("text" if c == "text" else f"k_{c}").alias(c) for c in keep], "n_bytes", "n_removed", "n_spans", "kept_sha256", *tail)


#: The digest columns in SQL, at the default length.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, doc_id, x, unnest(range(0, length(x) // 2)) AS i FROM d),
w AS (SELECT r, i, CASE WHEN 2 * i + 400 <= length(x) THEN md5(substr(x, 2 * i + 1, 400)) END AS k, substr(x, 2 * i + 1, 2) AS byte FROM p),
c AS (SELECT r, i, byte, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS rep FROM w),
g AS (SELECT r, i, byte, coalesce(bool_or(rep) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), false) AS gone FROM c),
s AS (SELECT r, i, byte, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM g),
a AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM s GROUP BY r)
SELECT d.doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(a.n_removed, 0)::BIGINT AS n_removed, coalesce(a.n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(a.kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""
