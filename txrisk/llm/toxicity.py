"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of its byte n-grams inside words (3 to 6 bytes, a blank marking either end of a word,
A-Z lower-cased), hashed into buckets.  Every bucket has an embedding; the text's vector is the average
over its n-grams, and a linear softmax gives the two class probabilities.  Embeddings and softmax are
trained jointly on mini-batches in numpy (Adam with a large epsilon, so that rare n-grams take small steps), so an unseen spelling is scored by the n-grams it
shares with known ones.

A long text dilutes an average, so it is judged by blocks of ``block`` words: the score is that of its
most toxic block, and training back-propagates through that block.

The classifier is fitted on a bounded sample: at most ``max_rows`` labelled rows of each class, chosen by
a hash of the id, of texts of at most ``max_train_bytes`` bytes.  The shift between the sample's and the
labels' class shares is taken back out of the softmax's offset.  All rows are scored.  Scoring folds
embeddings and softmax into one weight per bucket, which is the same model.

Defined cases: null and empty texts have a zero vector and get the offset's probability; a label counts as
toxic if it is 1, other rows with a null label are not used; without labels of both classes every score is
0; repeated and null ids give one row per input row (a null id hashes as the empty text); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import crc_mod, lean, texts

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 17
BLOCK = 8
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))


def subwords(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of every n-gram of a text."""
    words = text.translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    blank = raw == 32
    word = np.cumsum(blank, dtype=np.int32) - 1
    upto = np.concatenate(([0], np.cumsum(blank, dtype=np.int32)))
    h = raw.astype(np.uint32) + np.uint32(1)
    mix = h
    buckets, numbers = [], []
    for n in range(2, max(SIZES) + 1):
        if len(raw) < n:
            break
        mix = mix[: len(raw) - n + 1] * np.uint32(0x01000193) + h[n - 1 :] * np.uint32(0x9E3779B1)
        if n not in SIZES:
            continue
        m = len(raw) - n + 1
        at = np.flatnonzero(upto[n - 1 : n - 1 + m] == upto[1 : 1 + m])  # no blank strictly inside
        x = (mix[at] ^ (mix[at] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        buckets.append((x >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
        numbers.append(word[at + 1])
    last = len(words) - 1
    return np.concatenate(buckets), np.minimum(np.concatenate(numbers), last)


class Bags:
    """The n-grams of many texts in one array, block after block: a block is a slice, and four bytes an n-gram are all."""

    def __init__(self, samples: list[bytes], block: int):
        grams, sizes, counts = array("i"), [], []
        for t in samples:
            b, w = subwords(t)
            if not len(b):
                counts.append(0)
                continue
            of = np.minimum(w // block, max(0, (int(w.max()) + 1) // block - 1))  # a short last block joins the one before
            own = np.bincount(of)
            grams.frombytes(b[np.argsort(of, kind="stable")].astype(np.int32).tobytes())
            sizes.append(own)
            counts.append(len(own))
        self.grams = np.frombuffer(grams, np.int32) if len(grams) else np.zeros(0, np.int32)
        self.cuts = np.concatenate([[0], *sizes]).cumsum()
        self.first = np.concatenate(([0], np.cumsum(counts)))  # block number of a text's first block

    def most_toxic(self, i: int, folded: np.ndarray) -> np.ndarray:
        """The n-grams of the block of text i with the largest average weight; none of an empty text."""
        a, e = self.first[i], self.first[i + 1]
        if e - a > 1:
            cut = self.cuts[a : e + 1]
            total = np.add.reduceat(folded[self.grams[cut[0] : cut[-1]]], cut[:-1] - cut[0])
            a += int(np.argmax(total / np.diff(cut)))
        return self.grams[self.cuts[a] : self.cuts[a + 1]] if e > self.first[i] else self.grams[:0]


@dataclass
class Model:
    weight: np.ndarray  # per bucket: embedding . (softmax column 1 - column 0)
    offset: float
    block: int


def train(samples: list[tuple[bytes, int]], share: float, dim: int = 8, steps: int = 300, batch: int = 128, rate: float = 0.5, block: int = BLOCK, seed: int = 3, eps: float = 1e-3) -> Model:
    """Joint Adam training of bucket embeddings and softmax; ``share`` is the true share of class 1."""
    r = np.random.default_rng(seed)
    n_buckets = 1 << BUCKET_BITS
    emb = np.zeros((n_buckets, dim), np.float32)  # an n-gram that training never meets adds nothing
    soft = r.normal(0, 0.3, (dim, 2)).astype(np.float32)
    off = np.zeros(2, np.float32)
    bags = Bags([t for t, _ in samples], block)
    y = np.array([v for _, v in samples])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, soft, off)]
    step = 0
    for _ in range(-(-steps * batch // max(batch, len(samples)))):
        order = r.permutation(len(samples))
        folded = emb @ (soft[:, 1] - soft[:, 0])
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            parts, owner = [], []
            for k, i in enumerate(rows):
                b = bags.most_toxic(i, folded)
                if not len(b):
                    continue
                parts.append(b)
                owner.append(np.full(len(b), k))
            if not parts:
                continue
            b, o = np.concatenate(parts), np.concatenate(owner)
            per = np.maximum(np.bincount(o, minlength=len(rows)), 1).astype(np.float32)
            first = np.flatnonzero(np.diff(o, prepend=-1))
            vec = np.zeros((len(rows), dim), np.float32)
            vec[o[first]] = np.add.reduceat(emb[b], first, axis=0)
            vec /= per[:, None]
            logit = vec @ soft + off
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = (p @ soft.T) / per[:, None]
            used, at = np.unique(b, return_inverse=True)
            g = np.stack([np.bincount(at, back[o, d], minlength=len(used)) for d in range(dim)], 1).astype(np.float32)
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for (m, v), q, grad, rows_ in ((state[0], emb, g, used), (state[1], soft, vec.T @ p, slice(None)), (state[2], off, p.sum(0), slice(None))):
                m[rows_] = 0.9 * m[rows_] + 0.1 * grad
                v[rows_] = 0.999 * v[rows_] + 0.001 * grad * grad
                q[rows_] -= rate * fix * m[rows_] / (np.sqrt(v[rows_]) + eps)
    own = float(y.mean())
    shift = np.log(share / (1 - share)) - np.log(own / (1 - own))
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(off[1] - off[0] + shift), block)


def score_many(docs: list[list[bytes]], model: Model) -> np.ndarray:
    """Probability of class 1 of texts given as folded words.

    The n-grams of a block of words are neighbours, so a block's average is a sum between two places.
    """
    z = np.zeros(len(docs))
    some = [i for i, words in enumerate(docs) if words]
    if some:
        raw = np.frombuffer(b" " + b" ".join(b" ".join(docs[i]) for i in some) + b" ", np.uint8)
        blank = raw == 32
        upto = np.cumsum(blank, dtype=np.int32)
        h = raw.astype(np.uint32) + np.uint32(1)
        g = h * np.uint32(0x9E3779B1)
        value, count, mix = np.zeros(len(raw), np.float32), np.zeros(len(raw), np.int32), h
        for n in range(2, min(max(SIZES), len(raw)) + 1):
            m = len(raw) - n + 1
            mix = mix[:m] * np.uint32(0x01000193)
            mix += g[n - 1 :]
            if n in SIZES:
                x = mix ^ (mix >> np.uint32(15))
                x *= np.uint32(0x85EBCA6B)
                x >>= np.uint32(32 - BUCKET_BITS)
                inside = upto[n - 2 : n - 2 + m] == upto[:m]  # no blank between the first and the last byte
                value[:m] += model.weight[x] * inside
                count[:m] += inside
        words = np.array([len(docs[i]) for i in some])
        blocks = np.maximum(1, words // model.block)
        first = np.cumsum(blocks) - blocks
        number = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        starts = np.flatnonzero(blank)[np.repeat(np.cumsum(words) - words, blocks) + number * model.block]
        average = np.add.reduceat(value, starts) / np.maximum(np.add.reduceat(count, starts), 1)
        z[some] = np.maximum.reduceat(average, first)
    return 1 / (1 + np.exp(-np.clip(z + model.offset, -500, 500)))


def _score(shared, group_bytes: int = 1 << 17):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            own, group, size = [np.zeros(0)], [], 0
            for t in texts(b):
                group.append(t.translate(_FOLD).split())
                size += len(t)
                if size >= group_bytes:
                    own.append(score_many(group, model) if model else np.zeros(len(group)))
                    group, size = [], 0
            own.append(score_many(group, model) if model else np.zeros(len(group)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(own), pa.float64())], [*b.schema.names, "score"])

    return lean(run)


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int, held: int, max_rows: int, max_train_bytes: int) -> tuple[list[tuple[bytes, int]], float]:
    """At most ``max_rows`` rows of either class, and the share of class 1 among the training labels."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {bool(t): n for t, n in own.groupBy(F.col("toxic") == 1).count().collect()}
    if not counts.get(True) or not counts.get(False):
        return [], 0.0
    picked = [own.filter(F.col("toxic") == 1 if t else F.col("toxic") != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", F.lit(t).alias("y")) for t in (1, 0)]
    ids = picked[0].union(picked[1]).collect()  # at most 2 * max_rows ids
    ids = docs.sparkSession.createDataFrame(ids, picked[0].schema)
    text = docs.select(F.col("doc_id").alias("d"), F.col("text").cast("string").alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_train_bytes)
    rows = text.join(F.broadcast(ids), F.col("d") == F.col("doc_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [((x.text or "").encode(), x.y) for x in rows], counts[True] / (counts[True] + counts[False])


def toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_rows: int = 1500, max_train_bytes: int = 65_536, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns ``keep`` with held_out, score and predicted, one row per document."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    samples, share = labelled_sample(docs, labels, folds, held, max_rows, max_train_bytes)
    model = train(samples, share) if len({y for _, y in samples}) == 2 else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in keep if c != "text"]
    src = docs.select(*[F.col(c).alias(f"k_{c}") for c in own], F.col("text").cast("string").alias("text"), (crc_mod("doc_id", folds) == held).alias("held_out"))
    out = src.mapInArrow(_score(shared), StructType([*src.schema.fields, StructField("score", DoubleType())]))
    return out.select(*[F.col("text" if c == "text" else f"k_{c}").alias(c) for c in keep], "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
