"""Quality rules by cross-document line frequency.

Lines are normalised (white space collapsed, A-Z lower-cased) and hashed; for every host the
distinct documents holding a line are counted, lines above the limits are removed, and a document
that keeps too little of its words is rejected.

Counting is per distinct text: exact copies of one document within a host count once, so that a
copied article is not taken for boilerplate (copies are the near-duplicate operators' business).

Defined cases: null text has no words (all counts 0, base_failed true, kept false); a null host is
a host of its own; null or repeated doc_ids give one output row per input row; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import WHITE, covered, staged, texts, window_codes

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_DROP_WHITE = WHITE

_STATS = (
    "doc_id {id}, host string, text_key string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<line:long,words:long>>"
)
_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in some window occurring at least twice in the list."""
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    _, inverse, count = np.unique(window_codes(ids, len(seen), window), return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] >= 2)
    return int(covered(at, np.full(len(at), window), len(words)).sum()) if len(at) else 0


def text_stats(text: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {line hash: words})."""
    words: list[bytes] = []
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    dup = 0
    for raw in text.split(b"\n"):
        own = raw.split()
        if not own:
            continue
        words += own
        if raw in seen:
            dup += 1
        seen.add(raw)
        h = _signed(xxhash.xxh3_64_intdigest(b" ".join(own).lower()))
        lines[h] = lines.get(h, 0) + len(own)
    bare = text.translate(None, _DROP_WHITE)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), len(bare.decode("utf-8", "replace")), symbols, dup, repeat_words(words), lines


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(xxhash.xxh3_128_hexdigest(t), text_stats(t)) for t in texts(b)]
        cols = [b.column("doc_id"), b.column("host"), pa.array([k for k, _ in rows], pa.string())]
        cols += [pa.array([r[i] for _, r in rows], pa.int64()) for i in range(5)]
        cols.append(pa.array([[{"line": k, "words": v} for k, v in r[5].items()] for _, r in rows], _LINES))
        names = ["doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
        yield pa.RecordBatch.from_arrays(cols, names)


def quality_rules(
    docs: DataFrame, host: str = "source", min_docs: int = 10, min_share: float = 0.001, min_words: int = 10, max_repeat_pct: int = 20, min_left_pct: int = 50
) -> DataFrame:
    """One row per document with the base counts, the words left after line removal, and the verdict.

    A line is removed from the documents of a host if at least ``min_docs`` distinct texts of that host, and at least
    the share ``min_share`` of them, hold it.  A document is rejected when fewer than ``min_words`` words, or less than
    ``min_left_pct`` percent of its words, are left.
    """
    ids = dict(docs.select("doc_id").dtypes)["doc_id"]
    src = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    stats = staged(src.mapInArrow(_stats, _STATS.format(id=ids)), "quality")
    # one row per (host, text); equal texts have equal lines, so any row of the group will do
    own = staged(stats.groupBy("host", "text_key").agg(F.first("lines").alias("lines")), "quality-texts")
    sizes = own.groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    line = own.select("host", "text_key", F.explode("lines").alias("l")).select("host", "text_key", "l.line", "l.words")
    common = (
        line.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
        .join(sizes.withColumnRenamed("host", "host2"), F.col("host").eqNullSafe(F.col("host2")))
        .filter(F.col("n") >= F.col("texts") * F.lit(min_share)).select(F.col("host").alias("c_host"), F.col("line").alias("c_line"))
    )
    gone = (
        line.join(common, (F.col("line") == F.col("c_line")) & F.col("host").eqNullSafe(F.col("c_host")))
        .groupBy("host", "text_key").agg(F.sum("words").alias("n_line_words_removed"))
        .select(F.col("host").alias("g_host"), F.col("text_key").alias("g_key"), "n_line_words_removed")
    )
    out = stats.drop("lines").join(gone, (F.col("text_key") == F.col("g_key")) & F.col("host").eqNullSafe(F.col("g_host")), "left")
    n, left = F.col("n_words"), F.col("n_words") - F.col("n_line_words_removed")
    return (
        out.withColumn("n_line_words_removed", F.coalesce("n_line_words_removed", F.lit(0).cast("long")))
        .withColumn("base_failed", (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * n))
        .withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (100 * left >= min_left_pct * n))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words_removed")
    )


#: The same rows in SQL, at the default parameters.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n >= 2),
rw AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
raw AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT *, array_to_string(lw, ' ') AS norm FROM (SELECT r, host, text, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw FROM raw) WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY r),
hosts AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
common AS (SELECT l.host, l.norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM ln GROUP BY host, norm) l
  JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host WHERE l.n >= 10 AND l.n >= h.texts * 0.001),
gone AS (SELECT l.r, sum(len(l.lw)) AS n FROM ln l JOIN common c ON l.norm = c.norm AND l.host IS NOT DISTINCT FROM c.host GROUP BY l.r),
b AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words,
  length(translate(w.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(w.text) - length(translate(w.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_line_words_removed
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rw USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND n_words - n_line_words_removed >= 10 AND 100 * (n_words - n_line_words_removed) >= 50 * n_words) AS kept,
  n_line_words_removed
FROM b
"""
