"""Order-dependent operators that scale out: global positions, running sums, row-count rolling windows.

A window with ORDER BY but no PARTITION BY sends every row to one task.  These
operators keep the global order semantics while every stage stays parallel:

1. ``repartitionByRange`` on (groups, order keys) -- one shuffle; ties of a hot
   key are split across partitions by the unique tie-breaker, so no task holds
   a skewed group;
2. ``monotonically_increasing_id`` after ``sortWithinPartitions`` gives
   (partition id, row index inside the partition) without another shuffle;
3. rows per (partition, group) -> exclusive running count over partitions: a
   table of one row per (partition, group), joined back;
4. position = partition offset + row index.

Running sums and rolling frames cut the positions into blocks of ``block_rows``
rows.  A block is an ordinary window partition; rolling frames copy the last
``rows - 1`` positions of each block into the next one (halo) and drop the
copies afterwards; running sums add the exclusive total of earlier blocks.

``group_cols`` must be low-cardinality (a label, a model name): the offset
table grows with partitions x groups.  Order keys must end in a unique column
so that positions are deterministic and survive task re-execution.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.session import checkpoint_dir, shuffle_partitions

_ROW_BITS = 33  # monotonically_increasing_id: partition id in the upper 31 bits
DEFAULT_BLOCK_ROWS = 1 << 20  # upper bound of a window block (rows sorted in one task)
TASK_ROWS = 100_000  # wide rows of a task after :func:`spread`


def _names(cols: Sequence[str | Column]) -> list[str | Column]:
    return list(cols)


def task_count(rows: int) -> int:
    """Tasks for ``rows`` wide rows: ``TASK_ROWS`` each."""
    return max(1, -(-rows // TASK_ROWS))


def spread(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """``df`` of about ``rows`` rows dealt over :func:`task_count` tasks by ``cols``; a table of one task stays as it is.

    Adaptive execution sizes tasks by compressed bytes: well compressible wide rows end up in a few tasks, which sort
    by spilling and leave the other cores idle.  A number of tasks taken from the rows is kept by it.
    """
    n = task_count(rows)
    return df.repartition(max(n, shuffle_partitions(df.sparkSession)), *cols) if n > 1 else df  # a join deals fewer out again


@contextmanager
def scans_by_rows(spark: SparkSession, rows: int):
    """While this is open, a scan of a written table of ``rows`` rows in many files has about :func:`task_count` tasks.

    Otherwise small files are packed into one task a core, whatever their number of rows.
    """
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    if task_count(rows) > spark.sparkContext.defaultParallelism:
        spark.conf.set(key, str(task_count(rows)))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def with_positions(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    group_cols: Sequence[str] = (),
    pos_col: str = "_pos",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``pos_col``: 0-based row number in ``order_cols`` order within ``group_cols``.

    Equivalent to ``row_number() over (partition by groups order by keys) - 1``.
    Output is range-partitioned on (groups, keys).
    """
    n = num_partitions or shuffle_partitions(df.sparkSession)
    groups = list(group_cols)
    keys = groups + _names(order_cols)
    ranged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_rid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright(F.col("_rid"), _ROW_BITS))
    )
    # Row ids are only meaningful against one physical partitioning, and two branches read them
    # (offsets and rows), so the numbered rows are written once to the shared folder: no cache entry
    # that goes, and no plan made anew, can tell the branches apart.
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/txrisk-positions/{uuid.uuid4().hex}"
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    runs = ranged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_rid").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        F.col("_pid").alias("_opid"),
        *[F.col(g).alias(f"_og_{g}") for g in groups],
        "_first",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
    )
    cond = ranged["_pid"] == offsets["_opid"]
    for g in groups:
        cond = cond & ranged[g].eqNullSafe(offsets[f"_og_{g}"])
    # offsets: one row per (range partition, group); Spark broadcasts it when its size allows
    out = ranged.join(offsets, cond, "inner")
    out = out.withColumn(pos_col, F.col("_off") + F.col("_rid") - F.col("_first"))
    return out.drop("_rid", "_pid", "_opid", "_first", "_off", *[f"_og_{g}" for g in groups])


def positions_of(df: DataFrame, by: str, tie: str, keys: Sequence[tuple]) -> list[int]:
    """0-based positions of some (by, tie) keys in the order of ``df`` by these columns, without numbering or sorting it.

    A key's position is the number of rows before it.  The keys' values of ``by`` (a number) cut it into ranges; every
    row finds its range by bisection and the rows are counted per range, so (keys + 1) counts reach the driver.  Rows
    that share a key's ``by`` are counted by ``tie``.  Meant for the few rows of a report; keys hold no null.
    """
    from pyspark.ml.feature import Bucketizer

    if not keys:
        return []
    spark = df.sparkSession
    cuts = sorted({float(k[0]) for k in keys})
    narrow = df.select(F.col(by).cast("double").alias("_by"), F.col(tie).alias("_tie"))
    ranges = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_by", outputCol="_range")
    counts = {int(r[0]): r[1] for r in ranges.transform(narrow.select("_by")).groupBy("_range").count().collect()}
    before, seen = {}, 0
    for i, cut in enumerate(cuts):  # range i holds the rows from cut i - 1 on and below cut i
        seen += counts.get(i, 0)
        before[cut] = seen
    asked = spark.createDataFrame([(i, float(k[0]), k[1]) for i, k in enumerate(keys)], f"_key int, _at double, _with {dict(df.dtypes)[tie]}")
    same = narrow.filter(F.col("_by").isin(cuts)).join(F.broadcast(asked), F.col("_by") == F.col("_at"))  # one row a key
    ties = dict(same.filter(F.col("_tie") < F.col("_with")).groupBy("_key").count().collect())
    return [before[float(k[0])] + ties.get(i, 0) for i, k in enumerate(keys)]


def with_content_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Add a text id made of the row's content and a number among equal rows.

    Equal rows may be exchanged, so the rows with their ids are the same however the input is partitioned.
    The rows are written once to the shared folder; equal rows are numbered within the part that wrote them
    and shifted by the equal rows of earlier parts, so a row that is repeated very often is not one task.
    """
    spark = df.sparkSession
    key = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    path = f"{checkpoint_dir(spark).rstrip('/')}/txrisk-content/{uuid.uuid4().hex}"
    rows = df.withColumns({"_key": key, "_part": F.spark_partition_id()})
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    shift = shift.select("_key", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    number = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_key"))
    out = spread(rows, rows.count(), "_key", "_part").withColumn("_k", number).join(shift, ["_key", "_part"])
    ident = F.concat_ws("-", "_key", (F.col("_shift") + F.col("_k")).cast("string"))
    return out.select(ident.alias(id_col), *df.columns)


def attach_positions(
    df: DataFrame,
    order_cols: Sequence[str],
    key: str = "id",
    group_cols: Sequence[str] = (),
    pos_col: str = "_pos",
    num_partitions: int | None = None,
) -> DataFrame:
    """:func:`with_positions` computed on the narrow key columns only, joined back on the unique ``key``.

    The range shuffle, the written copy and the offsets work on a few columns;
    the wide rows are shuffled once, by the join.
    """
    cols = list(dict.fromkeys([key, *group_cols, *order_cols]))
    pos = with_positions(df.select(*cols), order_cols, group_cols=group_cols, pos_col=pos_col, num_partitions=num_partitions)
    n = pos.count()  # of the written positions
    return spread(df, n, key).join(spread(pos.select(key, pos_col), n, key), key)


def rolling_aggregate(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    aggs: dict[str, Column],
    rows: int,
    pos_col: str = "_pos",
    block_rows: int | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Frame ``ROWS BETWEEN rows-1 PRECEDING AND CURRENT ROW`` over the whole table.

    ``aggs`` maps output name -> aggregate Column (e.g. ``F.avg('Amount')``).
    Rows keep ``pos_col`` (global 0-based position).  Only ``(rows-1)/block_rows``
    of the rows are duplicated.
    """
    pos = with_positions(df, order_cols, pos_col=pos_col, num_partitions=num_partitions)
    block_rows = block_rows or auto_block_rows(pos, rows)
    return rolling_over_positions(pos, aggs, rows, pos_col=pos_col, block_rows=block_rows)


def auto_block_rows(pos: DataFrame, minimum: int = 1, n: int | None = None) -> int:
    """Block size giving about two blocks per core, between the frame length and DEFAULT_BLOCK_ROWS.

    ``pos`` is the output of :func:`with_positions`: counting it (unless ``n`` is known) reads the written
    positions, not the source again.
    """
    n = pos.count() if n is None else n
    cores = pos.sparkSession.sparkContext.defaultParallelism
    return int(max(minimum, min(DEFAULT_BLOCK_ROWS, -(-n // max(1, 2 * cores)))))


def rolling_over_positions(
    pos: DataFrame,
    aggs: dict[str, Column],
    rows: int,
    pos_col: str = "_pos",
    block_rows: int = DEFAULT_BLOCK_ROWS,
    n: int = 0,
) -> DataFrame:
    """Row frame over rows that already carry dense global positions (block/halo plan).

    Wide rows: give their number ``n``, and the blocks are dealt over tasks by it.
    """
    if block_rows < rows:
        raise ValueError("block_rows must be at least the frame length")
    blk = F.floor(F.col(pos_col) / F.lit(block_rows))
    in_halo = F.pmod(F.col(pos_col), F.lit(block_rows)) >= F.lit(block_rows - (rows - 1))
    expanded = pos.withColumn("_home", blk).withColumn(
        "_blk", F.explode(F.when(in_halo, F.array(blk, blk + 1)).otherwise(F.array(blk)))
    )
    frame = Window.partitionBy("_blk").orderBy(pos_col).rowsBetween(-(rows - 1), Window.currentRow)
    expanded = spread(expanded, n, "_blk")
    out = expanded.select("*", *[agg.over(frame).alias(name) for name, agg in aggs.items()])
    return out.filter(F.col("_blk") == F.col("_home")).drop("_blk", "_home")


def running_sums(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    value_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    suffix: str = "_cum",
    pos_col: str = "_pos",
    block_rows: int | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``order_cols`` order within ``group_cols``.

    Adds ``<col><suffix>`` per value column and ``pos_col``.
    """
    groups = list(group_cols)
    pos = with_positions(df, order_cols, group_cols=groups, pos_col=pos_col, num_partitions=num_partitions)
    block_rows = block_rows or auto_block_rows(pos)
    pos = pos.withColumn("_blk", F.floor(F.col(pos_col) / F.lit(block_rows)))
    local = Window.partitionBy(*groups, "_blk").orderBy(pos_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pos = pos.select("*", *[F.sum(c).over(local).alias(f"_l_{c}") for c in value_cols])
    totals = pos.groupBy(*groups, "_blk").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    earlier = Window.partitionBy(*groups).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    block_off = totals.select(
        *[F.col(g).alias(f"_bg_{g}") for g in groups],
        F.col("_blk").alias("_bblk"),
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in value_cols],
    )
    cond = pos["_blk"] == block_off["_bblk"]
    for g in groups:
        cond = cond & pos[g].eqNullSafe(block_off[f"_bg_{g}"])
    # one row per block: rows / block_rows; AQE broadcasts it when its runtime size is small.
    out = pos.join(block_off, cond, "inner")
    out = out.select(
        *pos.columns,
        *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{c}{suffix}") for c in value_cols],
    )
    return out.drop("_blk", *[f"_l_{c}" for c in value_cols])
