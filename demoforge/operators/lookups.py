"""Keyed lookups: id lists to texts, fact unions per cluster, table sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoforge.functions.text import py_strip
from demoforge.operators.joins import keyed_join
from demoforge.session import cut_lineage


def _with_weights(dim: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Attach to each dimension row how many reference rows point at it
    (a map-side-combined count), for hot-key salting in ``keyed_join``."""
    w = refs.groupBy(key).agg(F.count(F.lit(1)).alias("_w"))
    return dim.join(w, key, "left").fillna(0, ["_w"])


def lookup_list(df: DataFrame, row_key: str, ids: str, dim: DataFrame, dim_key: str, dim_val: str,
                out: str = "texts") -> DataFrame:
    """Replace an id list by the list of its texts, same order.

    Adds ``out`` (ARRAY<STRING>) and ``n_missing`` (ids without a text; the
    loader this mirrors raises on them)."""
    ex = df.select(row_key, F.posexplode(ids).alias("_p", "_id"))
    d = dim.select(F.col(dim_key).alias("_id"), F.col(dim_val).alias("_v"))
    j = keyed_join(ex, _with_weights(d, ex, "_id"), "_id", weight="_w",
                   salt_by=F.concat_ws("|", F.col(row_key).cast("string"), F.col("_p").cast("string")), how="left")
    g = j.groupBy(row_key).agg(
        F.sort_array(F.collect_list(F.struct("_p", "_v"))).alias("_l"),
        F.count(F.when(F.col("_v").isNull(), 1)).alias("n_missing"),
    )
    g = g.select(row_key, F.transform("_l", lambda x: x["_v"]).alias(out), "n_missing")
    return df.join(g, row_key, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>"))) \
        .withColumn("n_missing", F.coalesce(F.col("n_missing"), F.lit(0)))


def cluster_facts(questions: DataFrame, ids: str, dim: DataFrame, dim_key: str, dim_val: str,
                  cluster: str = "cluster") -> DataFrame:
    """Distinct facts over each cluster's questions: ``(cluster, facts,
    n_missing)`` with texts stripped and ordered by fact id.  Ids without a
    text are counted, clusters without any fact have an empty list."""
    # a cluster's ids come together in one shuffle, written once: weights, join
    # and the clusters without facts read the same table
    sets = cut_lineage(questions.groupBy(cluster).agg(F.array_distinct(F.flatten(F.collect_list(
        F.when(F.col(cluster).isNotNull(), F.col(ids))))).alias("_ids")))
    ex = sets.select(cluster, F.explode_outer("_ids").alias("_id"), F.coalesce(F.size("_ids"), F.lit(0)).alias("_m"))
    d = dim.select(F.col(dim_key).alias("_id"), F.col(dim_val).alias("_v"))
    j = keyed_join(ex, _with_weights(d, ex, "_id"), "_id", weight="_w",
                   salt_by=F.col(cluster).cast("string"), how="left")
    asked = F.col("_m") > 0
    found = F.when(F.col("_v").isNotNull(), F.struct("_id", py_strip("_v").alias("_t")))
    g = j.groupBy(cluster).agg(F.sort_array(F.collect_list(found)).alias("_l"),
                               F.count(F.when(asked & F.col("_v").isNull(), 1)).alias("n_missing"))
    return g.select(
        cluster, F.coalesce(F.transform("_l", lambda x: x["_t"]), F.array().cast("array<string>")).alias("facts"),
        F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


def table_set_texts(tables: Sequence[DataFrame], uid_col: str = "[SKIP] UID", skip_marker: str = "SKIP",
                    row_order: Sequence[str | None] | None = None) -> DataFrame:
    """Each row of each table to ``(uid, text)``; text = its columns without
    ``skip_marker`` in the name, NULL as '', joined by a blank.  The first
    uid wins in table order (then ``row_order`` inside a table)."""
    parts = []
    for i, t in enumerate(tables):
        order = row_order[i] if row_order and row_order[i] else None
        cols = [c for c in t.columns if skip_marker not in c and c != order]
        text = F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols])
        parts.append(t.select(
            F.col(f"`{uid_col}`").alias("uid"), text.alias("text"), F.lit(i).alias("_t"),
            (F.col(order) if order else F.lit(0)).cast("bigint").alias("_r"),
        ))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("uid").agg(F.min_by("text", F.struct("_t", "_r")).alias("text"))


def semi(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def attach(df: DataFrame, annotations: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    return df.join(annotations, on, how)


def shuffled(df: DataFrame, seed, key_out: str = "shuffle_key", order_col: str = "idx") -> DataFrame:
    """A seeded full permutation: rows sorted by a hash of (seed, row id)
    with a distributed range sort."""
    from demoforge.functions.draws import draw_hash
    return df.withColumn(key_out, draw_hash(F.lit(str(seed)), F.col(order_col))).orderBy(key_out, order_col)


def with_split(df: DataFrame, split: Column) -> DataFrame:
    return df.withColumn("split", split)
