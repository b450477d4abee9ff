"""Row filters and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def first_n(df: DataFrame, n: int | None = None, default: int | None = None, order_col: str = "idx") -> DataFrame:
    """First n rows in source order; n from the call, else the default, else all."""
    n = n if n is not None else default
    return df if n is None else df.orderBy(order_col).limit(n)


def max_chars(df: DataFrame, col: str, m: int) -> DataFrame:
    return df.where(F.char_length(col) < m)


def non_blank(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull() & (F.trim(col) != ""))


def filter_questions(df: DataFrame, difficulty: str | None = None) -> DataFrame:
    """Questions with an explanation, optionally of one difficulty; an empty
    result is an error (checked with a one-row probe, not a count)."""
    out = df.where(F.col("explanation").isNotNull())
    if difficulty is not None:
        out = out.where(F.col("arcset") == difficulty)
        if not out.select("arcset").limit(1).collect():
            raise ValueError(f"no question has arcset {difficulty!r}")
    return out


def select_tasks(df: DataFrame, name_col: str, ids: Sequence[str], first: bool = False) -> DataFrame:
    """Tasks whose name contains one of ``ids``; with ``first`` only the
    smallest matching name per id.  The id list is a parameter, checked per
    row as an array: no join."""
    arr = F.array(*[F.lit(i) for i in ids])
    if not first:
        return df.where(F.exists(arr, lambda i: F.instr(F.col(name_col), i) > 0))
    hits = df.select(name_col, F.explode(F.filter(arr, lambda i: F.instr(F.col(name_col), i) > 0)).alias("task_id"))
    return hits.groupBy("task_id").agg(F.min(name_col).alias(name_col))


def where_contains(df: DataFrame, col: str, s: str) -> DataFrame:
    return df.where(F.instr(F.col(col), s) > 0)


def retained(df: DataFrame, pred: Column) -> DataFrame:
    """Rows kept by ``pred`` over rows before."""
    return df.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count(F.when(pred, 1)).alias("n_kept"),
        F.round(F.avg(pred.cast("double")), 6).alias("share"),
    )
