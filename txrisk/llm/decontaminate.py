"""Benchmark decontamination by a prefix-filtered set join.

Every item gives its windows of ``window`` consecutive words (an item with fewer words is one window).
A window is a set of word shingles; a document holds the window only if it holds all of its shingles
(containment 1), so after ordering the shingles by rarity in the corpus a prefix of one shingle, the
rarest, has to be joined.  A joined place fixes where the window would have to start: the positional
bound (start not before the document) and the length bound (enough words left) discard places, and the
words are then compared one by one, so the result is exact.

Documents are scanned twice (shingle rarity, then the join) and never shuffled.  The benchmark side is
shipped to the tasks in blocks of at most ``block_bytes`` bytes of item text (a single longer item is a
block of its own), so its size is bounded whatever the size of the benchmark; more blocks mean more scans.

Defined cases: null or empty texts have no words; an item without words has no window; a null item_id is
named by the empty string; items may repeat; documents may repeat or have null ids (one output row per
input row); empty tables give no rows / no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import covered, lean, runs, staged, texts

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
SHINGLE = 3
_BITS = 21
_FLUSH = 1_000_000


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text."""
    return text.translate(_TABLE).split()


@dataclass
class Index:
    """The windows of a block of items, with words as ids from 1 (0: any other word)."""

    vocab: dict[bytes, int]
    words: np.ndarray  # windows x window, 0 beyond a window's length
    length: np.ndarray
    item_at: np.ndarray  # items of window j: items[item_at[j]:item_at[j + 1]]
    items: np.ndarray
    names: list[str]
    shingles: dict[int, np.ndarray]  # shingle length -> sorted codes
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # codes, bounds, window, offset


def _codes(ids: np.ndarray, m: int) -> np.ndarray:
    """Codes of the m-shingles of ids, 0 where a word is unknown."""
    n = len(ids) - m + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, known = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(m):
        part = ids[j : j + n]
        out = (out << _BITS) | part
        known &= part > 0
    return np.where(known, out, 0)


def build_index(items: list[tuple[str, bytes]], window: int) -> Index:
    vocab: dict[bytes, int] = {}
    holders: dict[tuple[int, ...], set[int]] = {}
    names: dict[str, int] = {}
    for name, text in items:
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words_of(text)]
        if not ids:
            continue
        k = names.setdefault(name, len(names))
        for i in range(max(1, len(ids) - window + 1)):
            holders.setdefault(tuple(ids[i : i + window]), set()).add(k)
    if len(vocab) >= 1 << _BITS:
        raise ValueError("a block of items has too many distinct words; lower block_bytes")
    keys = list(holders)
    words = np.zeros((len(keys), window), np.int64)
    for j, key in enumerate(keys):
        words[j, : len(key)] = key
    length = np.array([len(k) for k in keys], np.int64)
    sets = [sorted(holders[k]) for k in keys]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64))).astype(np.int64)
    flat = np.array([x for s in sets for x in s], np.int64)
    shingles = {}
    for m in range(1, SHINGLE + 1):
        rows = np.flatnonzero(np.minimum(length, SHINGLE) == m)
        if len(rows):
            own = np.concatenate([_codes(words[j, : length[j]], m) for j in rows])
            shingles[m] = np.unique(own)
    return Index(vocab, words, length, at, flat, list(names), shingles, {})


def choose_prefix(index: Index, rarity: dict[int, np.ndarray]) -> None:
    """For each window its rarest shingle; ties go to the smaller code, then the earlier place."""
    chosen: dict[int, list[tuple[int, int, int]]] = {}
    for j, n in enumerate(index.length):
        m = min(SHINGLE, int(n))
        codes = _codes(index.words[j, :n], m)
        seen = rarity[m][np.searchsorted(index.shingles[m], codes)]
        o = int(np.lexsort((np.arange(len(codes)), codes, seen))[0])
        chosen.setdefault(m, []).append((int(codes[o]), j, o))
    for m, rows in chosen.items():
        rows.sort()
        a = np.array(rows, np.int64)
        codes, first = np.unique(a[:, 0], return_index=True)
        index.prefix[m] = (codes, np.append(first, len(a)), a[:, 1].copy(), a[:, 2].copy())


def _batches(batch: pa.RecordBatch, vocab: dict[bytes, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word ids with a 0 after each document, document starts), of bounded size."""
    get, first, parts, starts, at = vocab.get, 0, [], [], 0
    for r, text in enumerate(texts(batch)):
        own = words_of(text)
        ids = np.fromiter((get(w, 0) for w in own), np.int64, len(own))
        parts += [ids, np.zeros(1, np.int64)]
        starts.append(at)
        at += len(ids) + 1
        if at >= _FLUSH:
            yield first, r + 1, np.concatenate(parts), np.array([*starts, at], np.int64)
            first, parts, starts, at = r + 1, [], [], 0
    if starts:
        yield first, batch.num_rows, np.concatenate(parts), np.array([*starts, at], np.int64)


def _count_shingles(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        total = {m: np.zeros(len(c), np.int64) for m, c in ix.shingles.items()}
        for b in batches:
            for _, _, ids, _ in _batches(b, ix.vocab):
                for m, known in ix.shingles.items():
                    codes = _codes(ids, m)
                    codes = codes[codes > 0]
                    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                    total[m] += np.bincount(at[known[at] == codes], minlength=len(known))
        for m, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m), pa.int32()), pa.array(at, pa.int64()), pa.array(t[at], pa.int64())], ["m", "at", "n"])

    return lean(run)


def find_hits(ix: Index, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every occurrence of a window in the ids."""
    found_s, found_w = [], []
    for m, (codes, bounds, window, offset) in ix.prefix.items():
        c = _codes(ids, m)
        place = np.flatnonzero(c)
        at = np.minimum(np.searchsorted(codes, c[place]), len(codes) - 1)
        same = codes[at] == c[place]
        place, at = place[same], at[same]
        many = bounds[at + 1] - bounds[at]
        ends = np.cumsum(many)
        k = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(bounds[at], many)
        start, w = np.repeat(place, many) - offset[k], window[k]
        ok = (start >= 0) & (start + ix.length[w] <= len(ids))  # positional and length bounds
        start, w = start[ok], w[ok]
        for j in range(ix.words.shape[1]):  # all words equal; the zeros between documents equal no word
            need = ix.length[w] > j
            ok = ~need | (ids[np.minimum(start + j, len(ids) - 1)] == ix.words[w, j])
            start, w = start[ok], w[ok]
        found_s.append(start)
        found_w.append(w)
    if not found_s:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_s), np.concatenate(found_w)


def _scan(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            spans, items, n_words = b.column("spans").to_pylist(), b.column("items").to_pylist(), np.zeros(b.num_rows, np.int64)
            for first, last, ids, starts in _batches(b, ix.vocab):
                n_words[first:last] = np.diff(starts) - 1
                start, w = find_hits(ix, ids)
                doc = np.searchsorted(starts, start, side="right") - 1
                order = np.argsort(doc, kind="stable")
                start, w, doc = start[order], w[order], doc[order]
                for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))), strict=True):
                    d = int(doc[lo])
                    r, n = first + d, int(starts[d + 1] - starts[d] - 1)
                    s, e = runs(covered(start[lo:hi] - starts[d], ix.length[w[lo:hi]], n))
                    spans[r] = (spans[r] or []) + np.stack([s, e], 1).ravel().tolist()
                    own = {ix.names[i] for j in np.unique(w[lo:hi]) for i in ix.items[ix.item_at[j] : ix.item_at[j + 1]]}
                    items[r] = sorted(set(items[r] or []) | own)
            cols = [b.column(c) for c in b.schema.names if c not in ("n_words", "spans", "items")]
            names = [c for c in b.schema.names if c not in ("n_words", "spans", "items")]
            cols += [pa.array(n_words, pa.int64()), pa.array([x or [] for x in spans], pa.list_(pa.int64())), pa.array([x or [] for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_words", "spans", "items"])

    return lean(run)


@lean
def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_hit, digest = [], []
        for n, spans, items in zip(b.column("n_words").to_pylist(), b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
            a = np.array(spans, np.int64).reshape(-1, 2)
            n_hit.append(int(covered(a[:, 0], a[:, 1] - a[:, 0], n).sum()) if len(a) else 0)
            digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        names = [c for c in b.schema.names if c != "n_hit"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n_hit, pa.int64()), pa.array(digest, pa.string())], [*names, "n_hit", "items_sha256"])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size, dealt by a hash of the item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * total // block_bytes) if total > block_bytes else 1
    for k in range(n):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r.item_id, (r.text or "").encode()) for r in own.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each document with n_words, items (sorted ids of occurring items), spans (hit word ranges
    as start, end pairs), n_hit, items_sha256 and contaminated."""
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    spark = docs.sparkSession
    own = [c for c in keep if c != "text"]
    cur = docs.select(
        *[F.col(c).alias(f"k_{c}") for c in own], F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    base = [f for f in cur.schema.fields if f.name not in ("n_words", "spans", "items")]
    schema = StructType([*base, StructField("n_words", LongType()), StructField("spans", ArrayType(LongType())), StructField("items", ArrayType(StringType()))])
    for k, items in enumerate(_blocks(benchmark, block_bytes)):
        ix = build_index(items, window)
        if ix.shingles:
            shared = spark.sparkContext.broadcast(ix)
            seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_shingles(shared), "m int, at long, n long")
            rarity = {m: np.zeros(len(c), np.int64) for m, c in ix.shingles.items()}
            for m, at, n in seen.groupBy("m", "at").agg(F.sum("n")).collect():  # at most one row per shingle of the block
                rarity[m][at] = n
            choose_prefix(ix, rarity)
        if k:
            cur = staged(cur, "decontaminate")
        cur = cur.mapInArrow(_scan(spark.sparkContext.broadcast(ix)), schema)
    if "text" not in keep:
        cur = cur.drop("text")
    done = cur.mapInArrow(_merge_spans, StructType([*cur.schema.fields, StructField("n_hit", LongType()), StructField("items_sha256", StringType())]))
    return done.select(*[F.col("text" if c == "text" else f"k_{c}").alias(c) for c in keep], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "items", "spans")


#: The digest columns in SQL, at the default window.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
    FROM (SELECT r, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT dw.r, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.k = bw.k),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS s FROM hit GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
    sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
