"""Alignment of two tokenizers over the same texts, with corpus-wide link counts.

Both tokenizers cut the bytes of a text (with one space before it) into intervals.  Every token points to the
farthest-right token that overlaps it: the token of the other tokenizer that covers its last byte, if that one ends
later.  Doubling the pointers (each takes its successor's successor, for all tokens of a block of texts at once in
numpy) ends when every token points to the last token of its component, which names its group.  So a chain of n
overlapping tokens takes log2(n) rounds, and texts of a block need no loop of their own, since both tokenizers end
where a text ends.

All A-B pairs of a group are links.  Each text keeps its distinct pairs of ids with the number of their links; Spark
counts the documents of every pair.  A pair in at least one part in ``HEAVY`` of all (document, pair) rows cannot be one
of more than ``HEAVY``: those reach the tasks as sorted arrays, and only the links of other pairs, none of which is
hot, are joined with their counts.

Defined cases: a text that is null, empty, not valid UTF-8, or not equal to the joined bytes of its A or its B tokens
(one with U+2581 in it, for instance) has no tokens: zeros and the empty text.  Every row is a document, repeated rows and
ids included; null ids are returned; an empty table gives no rows; other columns are ignored.  Groups of more than
``WIDE`` tokens are reduced to distinct ids before pairing; the distinct pairs of one text have to fit in a task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import staged, texts

BLOCK = 1 << 18  # bytes of text aligned at once
WIDE = 64
HEAVY = 1 << 18


class _Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(byte_bpe, encoding="utf-8") as f:
            spec = json.load(f)
        # the byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for code points from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
        # without special tokens the library has the ids of the file, and their strings are plain text
        self.encode_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_a = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for raw, i in ranks.items():
            self.bytes_a[i] = raw
        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self.encode_b = pieces.encode
        size = pieces.get_piece_size()
        spell = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [spell(i) for i in range(size)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        n = max(len(self.bytes_a), size)
        # an id's text followed by what may come after it: , | ;
        self.words = [f"{i}{sep}" for sep in ",|;" for i in range(n)]
        self.n = n

    def tokens(self, raw: bytes) -> tuple[list[int], list[int]]:
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return [], []
        if not text:
            return [], []
        a, b, want = self.encode_a(" " + text), self.encode_b(text), b" " + raw
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return [], []
        return a, b


@lru_cache(maxsize=2)
def _pair(byte_bpe: str, piece_bpe: str) -> _Pair:
    return _Pair(byte_bpe, piece_bpe)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from 0 in order, of the A and of the B tokens with these ends; both cut the same bytes."""
    n = len(end_a)
    to_b, to_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    # a component's terminal is its last A token, which ends with its last B token
    step = np.concatenate((np.where(end_b[to_b] > end_a, n + to_b, np.arange(n)) if n else to_b, to_a))
    while True:
        further = step[step]
        if np.array_equal(further, step):
            break
        step = further
    last = np.zeros(n, np.int64)
    last[step] = 1
    number = (np.cumsum(last) - 1)[step] if n else step
    return number[:n], number[n:]


def _links(a: np.ndarray, b: np.ndarray, doc: np.ndarray, ga: np.ndarray, gb: np.ndarray, na: np.ndarray, nb: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys doc * base^2 + a * base + b of the links, and how many links have each key."""
    wide = np.maximum(na, nb) > WIDE
    first = np.cumsum(nb) - nb
    times = np.where(wide, 0, nb)[ga]
    left = np.repeat(np.arange(len(a)), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + first[ga][left]
    keys = np.sort((doc[left] * base + a[left]) * base + b[right])
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[new], np.diff(np.append(new, len(keys)))
    more = [(keys, counts)]
    start = np.cumsum(na) - na
    for g in np.flatnonzero(wide):
        ua, ca = np.unique(a[start[g] : start[g] + na[g]], return_counts=True)
        ub, cb = np.unique(b[first[g] : first[g] + nb[g]], return_counts=True)
        more.append((((doc[start[g]] * base + ua)[:, None] * base + ub).ravel(), np.outer(ca, cb).ravel()))
    if len(more) == 1:
        return keys, counts
    keys, at = np.unique(np.concatenate([k for k, _ in more]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate([c for _, c in more]))
    return keys, total


def _align_block(pair: _Pair, block: list[bytes]) -> dict[str, list | np.ndarray]:
    """What :func:`align` keeps of each text of a block."""
    tokens = [pair.tokens(t) for t in block]
    n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
    a, b = (np.fromiter((i for t in tokens for i in t[k]), np.int64, count=int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
    doc_a, doc_b = (np.repeat(np.arange(len(block)), n) for n in (n_a, n_b))
    ga, gb = groups(np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b]))
    many = int(ga[-1]) + 1 if len(ga) else 0
    na, nb = np.bincount(ga, minlength=many), np.bincount(gb, minlength=many)
    doc_g = np.zeros(many, np.int64)
    doc_g[ga] = doc_a
    links = np.zeros(len(block), np.int64)
    np.add.at(links, doc_g, na * nb)
    keys, counts = _links(a, b, doc_a, ga, gb, na, nb, pair.n)
    # the text of the groups: A ids, |, B ids, ; and so on
    ends = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
    word = np.concatenate((a + pair.n * ends(ga), b + 2 * pair.n * ends(gb)))
    order = np.argsort(np.concatenate((2 * ga, 2 * gb + 1)), kind="stable")
    word, cut = word[order].tolist(), np.cumsum(n_a + n_b).tolist()
    spelt = ["".join(map(pair.words.__getitem__, word[s:e]))[:-1] for s, e in zip([0, *cut], cut, strict=False)]
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_g, minlength=len(block)), "n_links": links, "groups": spelt,
        "pairs": keys % (pair.n * pair.n), "counts": counts, "cuts": np.searchsorted(keys, np.arange(len(block) + 1) * (pair.n * pair.n)),
    }


_ROW = "rid long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, {text}groups_sha256 string"


def _blocks(values: Iterator[bytes]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for t in values:
        block.append(t)
        size += len(t)
        if size >= BLOCK or len(block) >= 4096:
            yield block
            block, size = [], 0
    if block:
        yield block


def _aligned(files: tuple[str, str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, rid = _pair(*files), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for block in _blocks(texts(batch)):
                d = _align_block(pair, block)
                n = len(block)
                cuts = pa.array(d["cuts"], pa.int32())
                cols = {"rid": pa.array(np.arange(rid, rid + n)), "doc_id": batch.column("doc_id").slice(at, n)}
                cols |= {c: pa.array(d[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
                if with_text:
                    cols["groups"] = pa.array(d["groups"], pa.string())
                cols["groups_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in d["groups"]], pa.string())
                cols["pairs"] = pa.ListArray.from_arrays(cuts, pa.array(d["pairs"], pa.int64()))
                cols["counts"] = pa.ListArray.from_arrays(cuts, pa.array(d["counts"], pa.int64()))
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
                at, rid = at + n, rid + n

    return run


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """``pair, docs, best``: documents of each pair a * base + b, and whether no pair of the same A id has more."""
    n = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    most = F.max("docs").over(Window.partitionBy("a"))  # at most one row per B id
    return n.withColumn("a", F.expr(f"pair div {base}L")).withColumn("best", F.col("docs") == most).drop("a")


def _sums(shared):
    """Sums over the links of known pairs, and the links of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, best = shared.value
        for b in batches:
            cuts = np.concatenate(([0], np.cumsum(b.column("pairs").value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            p, c = (b.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("pairs", "counts"))
            at = np.minimum(np.searchsorted(pair, p), max(0, len(pair) - 1))
            known = pair[at] == p if len(pair) else np.zeros(len(p), bool)
            per_row = lambda v: pa.array(np.diff(np.concatenate(([0], np.cumsum(v)))[cuts]), pa.int64())
            hit = np.where(known, c, 0)
            sums = [per_row(hit * best[at]), per_row(hit * docs[at])] if len(pair) else [per_row(hit), per_row(hit)]
            rest = pa.array(np.concatenate(([0], np.cumsum(~known)))[cuts], pa.int32())
            cols = [b.column(n) for n in b.schema.names if n not in ("pairs", "counts")]
            cols += [*sums, pa.ListArray.from_arrays(rest, pa.array(p[~known], pa.int64())), pa.ListArray.from_arrays(rest, pa.array(c[~known], pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, [n for n in b.schema.names if n not in ("pairs", "counts")] + ["known_best", "known_sum", "pairs", "counts"])

    return run


def align(docs: DataFrame, files: tuple[str, str] | None = None, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups.

    ``groups`` spells the alignment as ``a1,a2|b1;a3|b2,b3``; n_best counts the links whose pair is in as many documents
    as any pair of the same A id; count_sum adds up the documents of the links' pairs.
    """
    spark = docs.sparkSession
    files = files or default_files()
    base = _pair(*files).n
    ids = dict(docs.select("doc_id").dtypes)["doc_id"]
    row = _ROW.format(id=ids, text="groups string, " if with_text else "")
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = src.mapInArrow(_aligned(files, with_text), row + ", pairs array<long>, counts array<long>")
    number = "int" if base * base < 1 << 31 else "long"
    found = staged(found.withColumn("pairs", F.col("pairs").cast(f"array<{number}>")), "aligned", batch_rows=512)
    counts = staged(pair_counts(found, base), "pair-counts")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    heavy = F.col("docs") * HEAVY >= total  # true of at most HEAVY pairs
    top = np.array(counts.filter(heavy).select("pair", "docs", F.col("best").cast("int")).collect(), np.int64).reshape(-1, 3)
    top = top[np.argsort(top[:, 0])]
    shared = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(top[:, k]) for k in range(3)))
    part = staged(found.mapInArrow(_sums(shared), row + ", known_best long, known_sum long, pairs array<long>, counts array<long>"), "links", batch_rows=2048)
    rest = part.select("rid", F.explode(F.arrays_zip("pairs", "counts")).alias("l")).select("rid", F.col("l.pairs").alias("pair"), F.col("l.counts").alias("c"))
    rest = rest.join(counts.filter(~heavy), "pair").groupBy("rid")
    rest = rest.agg(F.sum(F.when(F.col("best"), F.col("c")).otherwise(F.lit(0))).alias("more_best"), F.sum(F.col("c") * F.col("docs")).alias("more_sum"))
    both = part.drop("pairs", "counts").join(rest, "rid", "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).cast("long")
    out = both.withColumns({"n_best": plus("known_best", "more_best"), "count_sum": plus("known_sum", "more_sum")})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_text else []))
