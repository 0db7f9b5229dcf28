"""Packing documents into sequences by large-item matching and best fit.

Every document is tokenised whole, an end id is appended, and only a document longer than the capacity
is cut (the first piece takes the remainder, the others are full).  The packing plan depends on lengths
only, so it is made from the histogram of piece lengths (at most ``capacity`` numbers): pieces above
one third of the capacity go at most two to a sequence, each matched greedily with the longest one that
still fits beside it; shorter pieces, longest first, go into the tightest remaining gap, and into new
sequences when no gap is left.  The plan is a bounded table of runs ("the pieces of length L with ranks
a to b go to sequences from s, k in each, at offset o"); each piece finds its place from its rank among
the pieces of its length, which Spark counts per chunk of documents and sums over chunks.

Ids come from the given byte-level BPE file.  The file's vocabulary (a token's rank is its id) is loaded
into the faster of the two installed BPE libraries; tests compare the ids with the file's own library.

Defined cases: null or empty text has only the end id; repeated or null doc_ids give pieces for every
input row; an empty table gives no rows; other columns are ignored.  The string of an added token of the file in a
text is that token, as the file's own library has it by default.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import lean, staged, texts

CAPACITY = 2048
END_ID = 0


@lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-level BPE encoder with the ids of a tokenizers JSON file.

    ``encode_ordinary`` takes the strings of added tokens as text, ``encode`` with all special tokens allowed as tokens.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for code points from 256
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(to_byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, chunk long, rank long"


def _tokenise(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, chunk = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for r, t in enumerate(texts(b)):
                ids = np.array([*enc.encode(t.decode("utf-8", "replace"), allowed_special="all"), END_ID], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    row.append(r)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    rank.append(int(seen[n]))
                    seen[n] += 1
            at = pa.array(row, pa.int64())
            cols = [b.column("doc_id").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            cols += [pa.array([chunk] * len(row), pa.int64()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank"])

    return lean(run)


def plan(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces per sequence, offset) for count[length] pieces.

    Piece number i of a run goes to sequence first + i // per, at offset + (i % per) * length.
    """
    left, used = count.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, sequences)]
    sequences = 0

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        out.append((length, int(used[length]), n, first, per, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    large = capacity // 3 + 1
    for a in range(capacity, large - 1, -1):  # the longest first
        while left[a]:
            b = next((x for x in range(min(a, capacity - a), large - 1, -1) if left[x] - (x == a) > 0), 0)
            n = int(left[a]) if not b else int(left[a]) // 2 if b == a else int(min(left[a], left[b]))
            first, sequences = sequences, sequences + n
            if b == a:
                place(a, 2 * n, first, 2, 0)
            else:
                place(a, n, first, 1, 0)
                if b:
                    place(b, n, first, 1, a)
            leave(capacity - a - b, first, n)
    for a in range(large - 1, 0, -1):
        while left[a]:
            fits = [g for g in gaps if g >= a]
            if not fits:
                per = capacity // a
                n = int(left[a])
                full, rest = divmod(n, per)
                if full:
                    place(a, full * per, sequences, per, 0)
                    leave(capacity - per * a, sequences, full)
                    sequences += full
                if rest:
                    place(a, rest, sequences, rest, 0)
                    leave(capacity - rest * a, sequences, 1)
                    sequences += 1
                continue
            g = min(fits)
            first, n = gaps[g].pop()
            if not gaps[g]:
                del gaps[g]
            per = g // a
            full, rest = divmod(int(left[a]), per)
            full = min(full, n)
            if full:
                place(a, full * per, first, per, capacity - g)
                leave(g - per * a, first, full)
            if full < n:  # fewer than per pieces are left, or none
                rest = min(rest, int(left[a]))
                if rest:
                    place(a, rest, first + full, rest, capacity - g)
                    leave(g - rest * a, first + full, 1)
                leave(g, first + full + bool(rest), n - full - bool(rest))
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ids = dict(docs.select("doc_id").dtypes)["doc_id"]
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    pieces = staged(src.mapInArrow(_tokenise(tokenizer or default_tokenizer(), capacity), _PIECES.format(id=ids)), "pieces")
    # the ranks before each chunk: at most (chunks x lengths) rows, summed along the chunks of one length
    per = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    count = np.zeros(capacity + 1, np.int64)
    for n, c in pieces.groupBy("length").agg(F.count(F.lit(1))).collect():  # at most `capacity` rows
        count[n] = c
    rows = plan(count, capacity)
    shared = spark.sparkContext.broadcast(_by_length(rows, capacity))
    ranked = pieces.join(before, ["length", "chunk"]).withColumn("at", F.col("rank") + F.col("before"))
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at")
    return out.mapInArrow(_place(shared), f"doc_id {ids}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _by_length(rows: list[tuple[int, int, int, int, int, int]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs sorted by (length, first rank), and one number per run by which they are searched."""
    a = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return a, (a[:, 0] << 48) + a[:, 1]


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, key = shared.value
        for b in batches:
            length, at = b.column("length").to_numpy(zero_copy_only=False), b.column("at").to_numpy(zero_copy_only=False)
            r = a[np.searchsorted(key, (length << 48) + at, side="right") - 1]
            i = at - r[:, 1]
            sequence, offset = r[:, 3] + i // r[:, 4], r[:, 5] + (i % r[:, 4]) * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return lean(run)
