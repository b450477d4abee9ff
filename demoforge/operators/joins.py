"""Joins against a per-key side table, with a checked size and hot-key salting.

``keyed_join`` is used wherever a large table meets a table with one row per
key that was derived from it (candidate lists per category, per element...).
The side table is broadcast only when a measured byte size is below a bound;
beyond it the join shuffles on the key, and keys that carry a large share of
the big side's rows are salted so that no single task receives them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark import StorageLevel

# Default ceiling for a broadcast side, in bytes of its JSON form (a close
# upper bound of its in-memory size for text-heavy rows).
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


#: an id list of at most this many rows may be broadcast
BROADCAST_IDS = 1_000_000


def join_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join of wide rows with an id list, which is counted: a
    short one is broadcast, so that the wide rows do not move."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, on, how)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def keyed_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    *,
    weight: str | None = None,
    salt_by: Column | None = None,
    how: str = "inner",
    broadcast_limit: int | None = None,
) -> DataFrame:
    """Join ``big`` with ``small`` on the non-null column ``key``.

    ``small`` has one row per key.  ``weight`` (a column of ``small``) is the
    number of rows of ``big`` expected under each key; keys holding more than
    1/(2P) of the total (P = shuffle partitions, so at most 2P keys) are
    spread over P salt values when the join has to shuffle.  ``salt_by`` is a
    deterministic column of ``big`` (a row id) used to pick the salt, so a
    retried task reproduces the same assignment.
    """
    # The side table is read three times (size, hot keys, join): keep it
    # (memory and disk; a lost block is recomputed from its lineage).
    small = small.persist(StorageLevel.MEMORY_AND_DISK)
    stats = small.agg(
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*small.columns)))), F.lit(0)).alias("bytes"),
        (F.coalesce(F.sum(weight), F.lit(0)) if weight else F.lit(0)).alias("w"),
    ).first()
    limit_bytes = BROADCAST_LIMIT_BYTES if broadcast_limit is None else broadcast_limit
    if stats["bytes"] <= limit_bytes:
        out = big.join(F.broadcast(small), key, how)
        return out.drop(weight) if weight else out
    parts = _partitions(big)
    hot: list = []
    if weight and salt_by is not None and stats["w"]:
        limit = stats["w"] / (2 * parts)
        hot = [r[0] for r in small.where(F.col(weight) > limit).select(key).limit(4 * parts).collect()]
    if not hot:
        out = big.join(small, key, how)
        return out.drop(weight) if weight else out
    is_hot_big = F.col(key).isin(hot)
    big_s = big.withColumn("_salt", F.when(is_hot_big, F.pmod(F.xxhash64(salt_by), F.lit(parts))).otherwise(F.lit(0)))
    small_s = small.withColumn(
        "_salt",
        F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))),
    )
    out = big_s.join(small_s, [key, "_salt"], how).drop("_salt")
    return out.drop(weight) if weight else out
