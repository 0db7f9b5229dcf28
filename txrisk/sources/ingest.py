"""CSV ingest with schema validation (by header name, never by position)."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.operators.ordering import with_content_ids
from txrisk.schema import EXPECTED_COLUMNS, LABEL


class SchemaError(ValueError):
    pass


def validate_columns(columns, expected=EXPECTED_COLUMNS) -> None:
    """Missing expected columns are an error that lists them; extra columns are allowed."""
    missing = [c for c in expected if c not in columns]
    if missing:
        raise SchemaError(f"the header lacks {missing}")


def _csv(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)


def first_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` lines of the files in order of their paths, as strings: the same on any number of splits.

    Lines are counted per split, for one file, then two more, four more and so on until there are enough, so later files
    are not read.  The result is whole files, the whole splits of the next file, and the first lines of one split;
    only that split is put in order.
    """
    raw = _csv(spark, path)
    plain = lambda f: re.sub(r"^(\w+):/+", r"\1:/", unquote(f))  # noqa: E731  the listing and the rows write file:/ differently
    files = sorted(unquote(f) for f in raw.inputFiles())
    number = {plain(f): i for i, f in enumerate(files)}
    taken, at, step, cut = 0, 0, 1, None
    while at < len(files) and cut is None:
        place = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")]
        counts = _csv(spark, files[at : at + step]).select(*place).groupBy("f", "b").count().collect()  # one row a split
        for f, b, c in sorted((number[plain(r["f"])], r["b"], r["count"]) for r in counts):
            if taken + c >= n:
                cut = (f, b, n - taken)
                break
            taken += c
        at, step = at + step, 2 * step
    if cut is None:
        return raw
    i, block, left = cut
    own = _csv(spark, [files[i]]).withColumns({"_b": F.col("_metadata.file_block_start"), "_r": F.monotonically_increasing_id()})
    edge = own.filter(F.col("_b") == block).orderBy("_r").limit(left)
    parts = [own.filter(F.col("_b") < block), edge]
    return union_all([*([_csv(spark, files[:i])] if i else []), *[p.drop("_b", "_r") for p in parts]])


def read_transactions_csv(spark: SparkSession, path: str, limit: int | None = None, id_col: str | None = "id") -> DataFrame:
    """Read a header CSV (one file, a folder or a glob) into the canonical typed layout.

    Every field is read as a string and bound by header *name*: a user schema
    on CSV would bind by position and silently swap shuffled columns.  Extra
    columns are dropped, order is canonicalised; values that do not parse
    become NULL (cleaned later), a non-integer label becomes NULL and is
    dropped by the label filter.  ``limit`` reads only the first n lines.
    Ids of the file are BIGINT if all are whole numbers, else text; null or
    repeated ids are an error.  Without ids, text ids are made from the content
    of the rows, so they depend neither on splits nor on the cluster.
    """
    raw = _csv(spark, path) if limit is None else first_rows(spark, path, limit)
    validate_columns(raw.columns)
    cols = []
    for c in EXPECTED_COLUMNS:
        if c == LABEL:
            cols.append(F.expr(f"try_cast(`{c}` AS INT)").alias(c))
        else:
            cols.append(F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c))
    has_ids = bool(id_col) and id_col in raw.columns
    if has_ids:
        cols.insert(0, F.col(id_col))
    df = raw.select(*cols)
    if has_ids:
        whole = _check_ids(raw, id_col)
        return df.withColumn(id_col, F.col(id_col).cast("bigint")) if whole else df
    return with_content_ids(df, id_col) if id_col else df


def _check_ids(raw: DataFrame, id_col: str) -> bool:
    """Null and repeated ids are errors; True if every id is a whole number written without sign or leading zeros."""
    whole = F.col(id_col).rlike("^(0|[1-9][0-9]{0,17})$")
    per_id = raw.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).withColumn("whole", whole)
    r = per_id.agg(
        F.count_if(F.col(id_col).isNull()).alias("nulls"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(~F.col("whole")).alias("texts")
    ).first()
    if r["nulls"] or r["repeated"]:
        raise SchemaError(f"column {id_col}: {'null ids; ' if r['nulls'] else ''}{r['repeated']} repeated values")
    return r["texts"] == 0


def union_all(frames) -> DataFrame:
    """Concatenate several inputs by column name."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
