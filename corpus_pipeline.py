"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import decontaminate, near_dup, packing, suffix_dedup, toxicity
from txrisk.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the smallest (doc_id, md5 of the text).

    A doc_id that stands for texts that are no near copies keeps all of them.  Documents without an id or without
    words are in no group and stay, every row of them.  Of rows equal in doc_id and text the smallest one stays.
    """
    own = docs.select(*COLUMNS).withColumn("text_key", near_dup.text_key())
    grouped = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^ \t\n\r\x0B\f]")
    shown = near_dup.decisions(docs, shingle=5).filter("shows").select("doc_id", "text_key").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = own.filter(grouped).join(shown, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.min(F.struct(*rest)).alias("row"))
    return one.select("doc_id", "row.*").select(*COLUMNS).union(own.filter(~grouped).select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated 200-byte passages; a document that had text and has none left goes."""
    out = suffix_dedup.remove_repeats(docs, keep=COLUMNS)
    return out.filter("n_removed = 0 OR length(trim(kept_text)) > 0").select(
        "doc_id", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text")).alias("text"), "lang", "source",
        F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long")).alias("n_chars"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return out.filter(~F.col("contaminated")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: The first stage is a trained model, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
