"""Token counts per document by a separator scan of flat token files.

A flat file is a run of token ids, cut into blocks of fixed size wherever they fall, with a separator id after each
document and no index.  Every block is searched for separators in numpy; a prefix scan over the blocks of a file
(separators so far, place of the last one) stitches the documents that cross block borders.

Files are made from the documents table, one per scan task, with the order of the doc_ids kept apart for naming the
counts.  The separator is an id that ordinary text never gets.

Defined cases: null and empty texts have 0 tokens; repeated and null ids give one row per input row; an empty table
gives no rows; other columns are ignored; a document may span any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import staged, texts
from txrisk.llm.packing import default_tokenizer, encoder

SEPARATOR = 50256
BLOCK = 1 << 16


def _write(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, file, block, ordinal = encoder(path), TaskContext.get().partitionId(), 0, 0
        rest = np.zeros(0, "<u4")
        names = ["file", "block", "tokens", "ordinal", "doc_id"]

        def blocks(parts: list[np.ndarray], ids: pa.DataType) -> pa.RecordBatch:
            nonlocal block
            n = len(parts)
            cols = [pa.array([file] * n, pa.int64()), pa.array(range(block, block + n), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, ids)]
            block += n
            return pa.RecordBatch.from_arrays(cols, names)

        kind = None
        for b in batches:
            kind, n = b.column("doc_id").type, b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(ordinal, ordinal + n), pa.int64()), b.column("doc_id")], names)
            ordinal += n
            for t in texts(b):
                rest = np.concatenate((rest, np.array([*enc.encode_ordinary(t.decode("utf-8", "replace")), SEPARATOR], "<u4")))
                full = len(rest) // size
                if full:
                    yield blocks([rest[k * size : (k + 1) * size] for k in range(full)], kind)
                    rest = rest[full * size :]
        if len(rest):
            yield blocks([rest], kind)

    return run


def _scan(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, ends, starts = [], [], []
            for t in b.column("tokens"):
                at = np.flatnonzero(np.frombuffer(t.as_py(), "<u4") == separator)
                n.append(len(at))
                ends.append(at)
                starts.append(np.concatenate(([-1], at[:-1] + 1)) if len(at) else at)  # -1: in an earlier block
            cut = np.concatenate(([0], np.cumsum(n)))
            docs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.arange(k) for k in n]), pa.int64()), *(pa.array(np.concatenate(x), pa.int64()) for x in (starts, ends))], ["k", "start", "end"])
            cols = [b.column("file"), b.column("block"), pa.array(n, pa.int64()), pa.array([int(e[-1]) if len(e) else None for e in ends], pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), docs)]
            yield pa.RecordBatch.from_arrays(cols, ["file", "block", "found", "last", "docs"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, file, start and n_tokens (without the separator) of every document."""
    ids = dict(docs.select("doc_id").dtypes)["doc_id"]
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    flat = staged(src.mapInArrow(_write(tokenizer or default_tokenizer(), block), f"file long, block long, tokens binary, ordinal long, doc_id {ids}"), "flat")
    stored = flat.filter("tokens IS NOT NULL").select("file", "block", "tokens")
    scanned = "file long, block long, found long, last long, docs array<struct<k:long,start:long,end:long>>"
    found = staged(stored.mapInArrow(_scan(SEPARATOR), scanned), "separators", batch_rows=256)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.drop("docs").select(
        F.col("file").alias("s_file"), F.col("block").alias("s_block"), F.coalesce(F.sum("found").over(before), F.lit(0)).alias("seen"),
        F.coalesce(F.max(F.col("block") * block + F.col("last")).over(before), F.lit(-1)).alias("carried"),
    )
    each = found.select("file", "block", F.explode("docs").alias("d")).join(scan, (F.col("file") == F.col("s_file")) & (F.col("block") == F.col("s_block")))
    start = F.when(F.col("d.start") < 0, F.col("carried") + 1).otherwise(F.col("block") * block + F.col("d.start"))
    ends = each.select("file", (F.col("seen") + F.col("d.k")).alias("ordinal"), start.alias("start"), (F.col("block") * block + F.col("d.end")).alias("end"))
    named = flat.filter("ordinal IS NOT NULL").select("file", "ordinal", "doc_id")
    return named.join(ends, ["file", "ordinal"]).select("doc_id", "file", "start", (F.col("end") - F.col("start")).alias("n_tokens"))
