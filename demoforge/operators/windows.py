"""Positional operators without a one-partition window.

A global ``row_number`` puts every row in one task.  Here positions come in
two levels: rows are range-partitioned on (group, order value) with sampled
boundaries, a small table of part counts is cumulated, and each row adds its
rank inside its part.  A part holds about the same number of rows whatever the
values are: an outlying id does not crowd the others together, and a group
holding a third of the rows spreads over a third of the parts.  The parts are
written once, so that counts and ranks see the same boundaries and the input
plan runs once.

NULL is a group of its own, like any other value of a ``by`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demoforge.session import cut_lineage


def _group(by: Sequence[str]) -> Column:
    """The ``by`` columns as one non-null key (NULL fields compare equal)."""
    return F.struct(*[F.col(c) for c in by]) if by else F.lit(0)


def _parts(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with ``_b``, their range part, ascending with (by, order)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return cut_lineage(df.repartitionByRange(parts, *by, *order).withColumn("_b", F.spark_partition_id()))


def _join_parts(rows: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = rows.withColumn("_g", _group(by))
    offsets = offsets.withColumn("_g", _group(by)).drop(*by)
    # without groups there is one row for each part
    return rows.join(offsets if by else F.broadcast(offsets), ["_g", "_b"]).drop("_g")


def dense_index(
    df: DataFrame,
    order_col: str = "idx",
    by: Sequence[str] = (),
    out: str = "pos",
    size_out: str | None = None,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Add ``out`` = 0-based position by ``order_col`` (ties ordered by
    ``tiebreak``) within ``by`` groups (whole table if empty); ``size_out`` =
    group size."""
    by = list(by)
    order = [order_col, *tiebreak]
    dfb = _parts(df, by, order)
    counts = dfb.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_b",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy(*by)).alias("_size"),
    )
    ranked = dfb.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)))
    res = _join_parts(ranked, offsets, by).withColumn(out, F.col("_off") + F.col("_rn") - 1)
    if size_out:
        res = res.withColumnRenamed("_size", size_out)
    return res.drop("_b", "_rn", "_off", "_size")


def running_sum(
    df: DataFrame,
    value: str | Column,
    by: Sequence[str],
    order_cols: Sequence[str],
    out: str = "running",
    total_out: str | None = None,
) -> DataFrame:
    """Cumulative sum of ``value`` per ``by`` in ``order_cols`` order (ties
    share a total, as SQL's default RANGE frame).  Two-level, so a hot key
    is summed part by part on many tasks."""
    by = list(by)
    v = F.col(value) if isinstance(value, str) else value
    dfb = _parts(df.withColumn("_rv", v), by, order_cols)
    totals = dfb.groupBy(*by, "_b").agg(F.sum("_rv").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"),
                            F.sum("_t").over(Window.partitionBy(*by)).alias("_tot"))
    inner = Window.partitionBy(*by, "_b").orderBy(*order_cols)
    res = _join_parts(dfb.withColumn("_in", F.sum("_rv").over(inner)), offsets, by)
    res = res.withColumn(out, F.col("_off") + F.col("_in"))
    if total_out:
        res = res.withColumnRenamed("_tot", total_out)
    return res.drop("_b", "_rv", "_in", "_off", "_tot")


def block_clusters(df: DataFrame, k: int = 3, order_col: str = "idx", out: str = "cluster") -> DataFrame:
    """Cluster = (n - 1 - pos) div (K + 1): blocks of K+1 rows from the end,
    which is what the greedy pairing loop reduces to (its score never rises)."""
    pos = dense_index(df, order_col, out="_pos", size_out="_n")
    return pos.withColumn(out, F.floor((F.col("_n") - 1 - F.col("_pos")) / F.lit(k + 1)).cast("bigint")).drop(
        "_pos", "_n"
    )


def micro_batches(df: DataFrame, batch_size: int, order_col: str = "idx", out: str = "batch_id") -> DataFrame:
    """Consecutive groups of ``batch_size`` rows; the last may be short."""
    pos = dense_index(df, order_col, out="_pos")
    return pos.withColumn(out, F.floor(F.col("_pos") / F.lit(batch_size)).cast("bigint")).drop("_pos")


def category_index(df: DataFrame, category: str = "category", order_col: str = "idx") -> DataFrame:
    """Position of each row inside its category and the category size."""
    return dense_index(df, order_col, by=[category], out="cat_pos", size_out="cat_size")


def dedup_first(df: DataFrame, key: str | Column, order_col: str = "idx") -> DataFrame:
    """First row per key in ``order_col`` order, via ``min_by`` (partial
    aggregation, so a key with many copies is reduced map-side).  A key that
    is a text is grouped by its length and 128-bit digest."""
    k = F.col(key) if isinstance(key, str) else key
    if df.select(k.alias("k")).schema["k"].dataType.typeName() == "string":
        k = F.struct(F.unhex(F.md5(F.coalesce(k, F.lit("")))).alias("h"), F.coalesce(F.length(k), F.lit(-1)).alias("n"))
    cols = df.columns
    first = df.groupBy(k.alias("_key")).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_row"))
    return first.select("_row.*")
