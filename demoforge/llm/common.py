"""Shared helpers of the pipeline operators: intermediate tables in the shared
checkpoint folder, row removal, connected components."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demoforge.session import ensure_checkpoint_dir

#: an id list of at most this many rows may be broadcast (its size is counted
#: first); a longer one goes through a shuffle join
BROADCAST_IDS = 1_000_000


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on
    a cluster it is shipped or installed; a path that is absent there does no
    harm)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


class Workspace:
    """Intermediate tables of one job, as Parquet in ``spark.checkpoint.dir``.

    A written table ends the lineage, survives lost executors and is computed
    once however often it is read."""

    def __init__(self, spark: SparkSession, name: str):
        on_workers(spark)
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, tag: str = "t") -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{tag}"

    def save(self, df: DataFrame, tag: str = "t") -> DataFrame:
        path = self.path(tag)
        schema = df.schema
        df.write.mode("error").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._table_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._table_path)
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files of finished jobs."""
        gc.collect()
        self.spark._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower))


def shuffle_join(df: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join with an exchange on both sides, whatever Spark takes ``other``
    for: rows that were compressed, exploded or made in Python may be many times
    the file below them, and a broadcast of them would go through the driver."""
    return df.join(other.hint("merge"), on, how)


def join_ids(df: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join of a wide table with an id list.  The list is counted:
    a short one is broadcast, so that the wide rows do not move; a longer one
    takes a shuffle join."""
    if ids.count() <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), on, how)
    return shuffle_join(df, ids, on, how)


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, component) for every node of an edge, the
    component named by its smallest node.

    Alternating large-star / small-star: every round re-hangs neighbours on the
    smallest one, on written tables; minima combine before the shuffle and the
    joins have a plain exchange on both sides, so that adaptive execution can
    split a hub.  Rounds grow with the logarithm of the component size."""
    def oriented(df):
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()

    def state(df):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    e = ws.save(oriented(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    last = state(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = ws.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "min")
        big = shuffle_join(both.filter("v > u"), m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e1 = ws.save(oriented(big), "large")
        m1 = ws.save(e1.groupBy("u").agg(F.min("v").alias("m")), "min")
        small = shuffle_join(e1, m1, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e2 = ws.save(oriented(small.unionByName(m1.withColumnRenamed("m", "v"))), "small")
        now = state(e2)
        ws.drop(e, m, e1, m1)
        e = e2
        if now == last:
            break
        last = now
    # every node now hangs on its component's smallest one
    return ws.save(
        e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()),
        "components",
    )


def key_groups(batches, keys: list[str]):
    """From Arrow batches of rows sorted by integer ``keys``: (key, columns) of
    each key's rows, as numpy arrays (binary and string columns as objects)."""
    import numpy as np

    def column(b, name):
        c = b.column(name)
        if str(c.type) in ("binary", "string", "large_binary", "large_string"):
            return np.array(c.to_pylist(), dtype=object)
        return c.to_numpy(zero_copy_only=False)

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = {n: column(b, n) for n in b.schema.names}
        if held is not None:
            cols = {n: np.concatenate([held[n], cols[n]]) for n in cols}
        change = np.zeros(len(cols[keys[0]]) - 1, dtype=bool)
        for k in keys:
            change |= cols[k][1:] != cols[k][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, z in zip(cuts, cuts[1:]):
            yield tuple(cols[k][a] for k in keys), {n: c[a:z] for n, c in cols.items()}
        held = {n: c[cuts[-1]:] for n, c in cols.items()}
    if held is not None:
        yield tuple(held[k][0] for k in keys), held
