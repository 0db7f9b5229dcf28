r"""Removal of lines that many documents share, in DataFrame functions only.

Lines are exploded with their positions, normalised (ASCII white space off both ends, A-Z lower-cased) and hashed
to two 64-bit numbers; distinct documents are counted per hash; lines of hashes over the threshold are dropped
everywhere but in the largest doc_id that holds them, and every text is put together again from the lines whose
positions were not dropped.

The exploded table holds ids, positions and hashes, never text, and is written once.  Distinct documents are
counted in two steps (hash and id, then hash), so a line held by a third of all documents is spread over tasks.
A hash holding at least one part in ``HEAVY`` of all (document, line) rows over the threshold cannot be one of more than
``HEAVY``; those few are matched by broadcast, all others by a join in which no key is hot.

Defined cases: a null or empty text is one empty line; a text that loses all its lines is empty; keys shorter
than ``min_chars`` code points never go.  A doc_id stands for one document however many rows have it: its rows
count once, and every one of them keeps its lines if the id is the largest; a null id is one document, below all
others.  Repeated rows give one row each; an empty table gives no rows; other columns, ``keep`` excepted, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import staged

MIN_CHARS = 40
MIN_DOCS = 5
HEAVY = 2000
_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(_WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _text_key() -> list[Column]:
    return [F.xxhash64("_text").alias("_t1"), F.xxhash64(F.lit(1), "_text").alias("_t2")]


def _same(left: DataFrame, right: DataFrame, id_col: str) -> Column:
    return left["_id"].eqNullSafe(right[id_col])


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``h1, h2, docs, last``: hashes held by at least ``min_docs`` documents, and the largest id holding them."""
    n = F.count_distinct("_id") + F.max(F.col("_id").isNull().cast("int"))
    return lines.groupBy("h1", "h2").agg(n.alias("docs"), F.max("_id").alias("last")).filter(F.col("docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, the ``keep`` columns, kept_text, n_lines, n_dropped."""
    src = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    # the text's hashes come before the explode: beside it they would be computed anew for every line
    every = src.select("_id", "_text", *_text_key()).select("_id", "_t1", "_t2", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
    keyed = every.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    lines = staged(keyed.select("_id", "_t1", "_t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    hot = staged(shared_lines(lines, min_docs), "shared-lines")
    total = hot.agg(F.sum("docs")).first()[0] or 0
    heavy = F.col("docs") * HEAVY >= total  # true of at most HEAVY hashes
    known = F.broadcast(hot.filter(heavy))
    found = lines.join(known, ["h1", "h2"]).unionByName(lines.join(known.select("h1", "h2"), ["h1", "h2"], "left_anti").join(hot.filter(~heavy), ["h1", "h2"]))
    gone = found.filter(~F.col("_id").eqNullSafe(F.col("last"))).groupBy(F.col("_id").alias("g_id"), F.col("_t1").alias("g1"), F.col("_t2").alias("g2"))
    gone = gone.agg(F.array_sort(F.collect_set("pos")).alias("gone"))  # at most the lines of one text
    text = src.select("*", *_text_key())
    both = text.join(gone, _same(text, gone, "g_id") & (F.col("_t1") == F.col("g1")) & (F.col("_t2") == F.col("g2")), "left")
    both = both.withColumns({"_lines": F.split("_text", "\n", -1), "_n": F.coalesce(F.size("gone"), F.lit(0))})
    # one character a line, 1 for a dropped one; all array steps take time in proportion to the lines
    before = lambda i: F.get("gone", i) - F.coalesce(F.get("gone", i - 1), F.lit(-1)) - 1
    marks = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.concat(F.repeat(F.lit("0"), before(i)), F.lit("1")))
    mask = F.concat(F.array_join(marks, ""), F.repeat(F.lit("0"), F.size("_lines") - F.element_at("gone", -1) - 1))
    left = F.zip_with("_lines", F.split(mask, "", -1), lambda line, flag: F.when(flag == "0", line))
    kept = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))  # nulls are left out
    return both.select(
        F.col("_id").alias("doc_id"), *[F.col(f"_keep_{c}").alias(c) for c in keep], kept.alias("kept_text"), F.size("_lines").cast("long").alias("n_lines"), F.col("_n").cast("long").alias("n_dropped")
    )


#: The same rows in SQL, at the default parameters.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key
  HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 5),
m AS (SELECT r, doc_id, pos, line, hot.key IS NOT NULL AND doc_id IS DISTINCT FROM hot.last AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
