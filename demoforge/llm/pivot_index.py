"""Embedding near duplicates through a pivot-permutation index.

Every different vector is described by the ordered list of its nearest
reference points (pivots); the first ``PREFIX`` of them are its prefix.
Vectors with the same prefix set form a cell.  Inverted lists hold cells under
every combination of ``SHARED`` pivots of their prefix, so two cells meet
exactly if they share that many pivots; a pair is taken in the list of its
smallest shared pivots only, hence once.

Verification is by cosine in double precision.  A cell knows its centre and
radius on the sphere: two cells are linked throughout, or not at all, when the
triangle inequality says so; only the others compare their vectors.  Cells of
more than ``BLOCK`` vectors are split into blocks, which meet like cells.  Link
counts leave a comparison per vector, and links as a spanning forest, never as
all pairs.

Equal vectors are one class with a multiplicity; they link with each other.
Null, empty, zero vectors and vectors with null or non-finite components link
with nothing.  Every length of vectors has pivots of its own, so vectors meet
only those of their length.  Ties among pivots go to the lower pivot.  An empty table
gives an empty result; other columns are ignored.

The pivots are the only part of the index that is fitted: of the ``SAMPLE``
different vectors of a length that are least by a hash of their bytes, at most ``PIVOTS``
that lie apart (cosine below ``APART``), so that a dense cluster holds one of
them and its members keep the same prefix.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoforge.llm.common import Workspace, connected_components, key_groups, shuffle_join

PIVOTS = 1024
SAMPLE = 4096
APART = 0.6
PREFIX = 8
SHARED = 3
BLOCK = 1024
MARGIN = 1e-6


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    """vec_id, key (digest of the vector, null if it links with nothing), vec
    (doubles), size."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys, vecs, sizes = [], [], []
            for v in b.column("v").to_pylist():
                x = np.array(v if v is not None and None not in v else [], dtype=np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    raw = x.tobytes()
                    keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                    vecs.append(raw)
                    sizes.append(len(x))
                else:
                    keys.append(None)
                    vecs.append(None)
                    sizes.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary()), pa.array(sizes, pa.int32())],
                names=["vec_id", "key", "vec", "size"])

    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(
        run, "vec_id long, key binary, vec binary, size int")


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _apart(points: np.ndarray, most: int) -> np.ndarray:
    """Points of which no two have a cosine of APART or more."""
    kept: list[int] = []
    free = np.ones(len(points), dtype=bool)
    for i in range(len(points)):
        if free[i] and len(kept) < most:
            kept.append(i)
            free &= points @ points[i] < APART
    return points[kept]


def _prefixes(classes: DataFrame, pivots: np.ndarray, prefix: int, base: int) -> DataFrame:
    """cid, n, vec and sig, the prefix as a sorted list of pivots, which are
    numbered from ``base``."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                sim = _unit(b.column("vec").to_pylist()) @ pivots.T
                near = np.argsort(-sim, axis=1, kind="stable")[:, :prefix]
                yield pa.RecordBatch.from_arrays(
                    [b.column("cid"), b.column("n"), b.column("vec"),
                     pa.array((np.sort(near, axis=1) + base).astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["cid", "n", "vec", "sig"])

    return classes.select("cid", "n", "vec").mapInArrow(run, "cid long, n long, vec binary, sig array<int>")


def _cells(members: DataFrame) -> DataFrame:
    """One row per cell: ids, multiplicities, vectors, centre and radius."""

    def run(batches):
        import pyarrow as pa

        for (cell,), g in key_groups(batches, ["cell"]):
            raw = g["vec"].tolist()
            u = _unit(raw)
            c = u.sum(axis=0)
            c = c / max(np.linalg.norm(c), 1e-300) if len(u) > 1 else u[0]
            radius = float(np.arccos(np.clip(u @ c, -1, 1)).max()) if len(u) > 1 else 0.0
            yield pa.RecordBatch.from_arrays(
                [pa.array([cell], pa.int64()), pa.array([g["cid"].tolist()], pa.list_(pa.int64())), pa.array([g["n"].tolist()], pa.list_(pa.int64())),
                 pa.array([b"".join(raw)], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([radius], pa.float64())],
                names=["cell", "cids", "ns", "vecs", "centre", "radius"])

    return (members.select("cell", "cid", "n", "vec").repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(run, "cell long, cids array<long>, ns array<long>, vecs binary, centre binary, radius double"))


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the same nodes as a symmetric link table does."""
    n = len(linked)
    free, edges = np.ones(n, dtype=bool), []
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            new = np.flatnonzero(linked[i] & free)
            free[new] = False
            edges += [(i, int(j)) for j in new]
            stack += new.tolist()
    return edges


def _compare(cos: float, a_raw: bytes, b_raw: bytes | None, a_ids, b_ids, a_n, b_n):
    """(id, weight of its links) and edges within a cell (b: None) or between two."""
    a = _unit([a_raw[k * (len(a_raw) // len(a_ids)):(k + 1) * (len(a_raw) // len(a_ids))] for k in range(len(a_ids))])
    if b_raw is None:
        hit = a @ a.T >= cos
        np.fill_diagonal(hit, False)
        w = hit @ np.array(a_n)
        return [(i, int(x)) for i, x in zip(a_ids, w) if x], [(a_ids[i], a_ids[j]) for i, j in _forest(hit)]
    size = len(b_raw) // len(b_ids)
    b = _unit([b_raw[k * size:(k + 1) * size] for k in range(len(b_ids))])
    hit = a @ b.T >= cos
    out = [(i, int(x)) for i, x in zip(a_ids, hit @ np.array(b_n)) if x] + [(j, int(x)) for j, x in zip(b_ids, hit.T @ np.array(a_n)) if x]
    if not out:
        return out, []
    both = np.zeros((len(a) + len(b),) * 2, dtype=bool)
    both[: len(a), len(a):], both[len(a):, : len(a)] = hit, hit.T
    ids = [*a_ids, *b_ids]
    return out, [(ids[i], ids[j]) for i, j in _forest(both)]


RESULT = "a long, b long, w long"  # a link (w null), or an id (b null) with the weight of its links


def _rows(found):
    import pyarrow as pa

    cols = list(zip(*found)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "w"])


def _inside(cells: DataFrame, cos: float) -> DataFrame:
    limit = math.acos(cos)

    def run(batches):
        for b in batches:
            out = []
            for ids, ns, raw, radius in zip(*(b.column(c).to_pylist() for c in ("cids", "ns", "vecs", "radius"))):
                if 2 * radius <= limit - MARGIN:
                    total = sum(ns)
                    out += [(i, None, total - n) for i, n in zip(ids, ns)] + [(i, ids[0], None) for i in ids[1:]]
                else:
                    w, e = _compare(cos, raw, None, ids, None, ns, None)
                    out += [(i, None, x) for i, x in w] + [(i, j, None) for i, j in e]
            yield _rows(out)

    return cells.filter(F.size("cids") > 1).select("cids", "ns", "vecs", "radius").mapInArrow(run, RESULT)


def _verdicts(pairs: DataFrame, cos: float) -> DataFrame:
    """(x, y, cx, rx, cy, ry) -> x, y, all: are the cells linked throughout?
    Pairs that cannot hold a link are left out."""
    limit = math.acos(cos)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            raw = [b.column(c).to_pylist() for c in ("cx", "cy")]
            size = np.array([len(x) for x in raw[0]])
            angle = np.zeros(b.num_rows)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                cx, cy = (np.frombuffer(b"".join(x[i] for i in at), dtype=np.float64).reshape(len(at), -1) for x in raw)
                angle[at] = np.arccos(np.clip((cx * cy).sum(axis=1), -1, 1))
            r = b.column("rx").to_numpy() + b.column("ry").to_numpy()
            keep = np.flatnonzero(angle - r <= limit + MARGIN)
            yield pa.RecordBatch.from_arrays(
                [b.column("x").take(pa.array(keep)), b.column("y").take(pa.array(keep)), pa.array((angle + r <= limit - MARGIN)[keep])], names=["x", "y", "all"])

    return pairs.mapInArrow(run, "x long, y long, all boolean")


def _between(joined: DataFrame, cos: float) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            for a_ids, a_n, a, b_ids, b_n, v in zip(*(b.column(c).to_pylist() for c in ("cids", "ns", "vecs", "cids2", "ns2", "vecs2"))):
                w, e = _compare(cos, a, v, a_ids, b_ids, a_n, b_n)
                out += [(i, None, x) for i, x in w] + [(i, j, None) for i, j in e]
            yield _rows(out)

    return joined.select("cids", "ns", "vecs", "cids2", "ns2", "vecs2").mapInArrow(run, RESULT)


def _throughout(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Results for pairs of cells that are linked throughout."""
    slim = cells.select("cell", "cids", F.expr("aggregate(ns, 0L, (s, n) -> s + n)").alias("total"), F.col("cids")[0].alias("first"))
    whole = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    # weights met by a cell add up before they reach its vectors
    w = shuffle_join(whole, slim.select(F.col("cell").alias("y"), "total"), "y").groupBy("x").agg(F.sum("total").alias("w"))
    w = (shuffle_join(w, slim.select(F.col("cell").alias("x"), "cids"), "x")
         .select(F.explode("cids").alias("a"), F.lit(None).cast("long").alias("b"), "w"))
    # vectors of one cell hang on its first one, the two first ones on each other
    touched = shuffle_join(whole.select(F.col("x").alias("cell")).distinct(), slim.select("cell", "cids", "first"), "cell")
    hang = touched.select(F.explode("cids").alias("a"), F.col("first").alias("b"), F.lit(None).cast("long").alias("w")).filter("a <> b")
    firsts = shuffle_join(pairs, slim.select(F.col("cell").alias("x"), F.col("first").alias("a")), "x")
    firsts = (shuffle_join(firsts, slim.select(F.col("cell").alias("y"), F.col("first").alias("b")), "y").select("a", "b", F.lit(None).cast("long").alias("w")))
    return w.unionByName(hang).unionByName(firsts)


def near_duplicates(df: DataFrame, cos: float = 0.9, vector: str = "embedding", pivots: int = PIVOTS,
                    prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = df.sparkSession
    ws = Workspace(spark, "pivots")
    rows = ws.save(_vectors(df, vector), "vectors")
    classes = ws.save(rows.filter("key is not null").groupBy("key", "size").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.max("vec").alias("vec"))
                      .withColumn("cid", F.monotonically_increasing_id()), "classes")
    # one length at a time: the driver holds one sample; a vector alone has no partner
    sizes = sorted(r["size"] for r in classes.groupBy("size").agg(F.count("*").alias("m")).filter("m > 1").collect())
    parts, widths, base = [], set(), 0
    for size in sizes:
        usable = classes.filter(F.col("size") == size)
        sample = [bytes(r[0]) for r in usable.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").collect()]
        points = _apart(_unit(sample), pivots)
        parts.append(ws.save(_prefixes(usable, points, prefix, base), "prefixes"))
        widths.add(min(prefix, len(points)))
        base += len(points)
    members = reduce(DataFrame.unionByName, parts or [ws.save(_prefixes(classes.limit(0), np.zeros((1, 1)), prefix, 0), "prefixes")])
    counts = ws.save(members.groupBy("sig").agg(F.count("*").alias("m")), "signatures")
    # the blocks of a signature are numbered cells
    sigs = ws.save(counts.select("sig", "m", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("m") / BLOCK) - 1).cast("int"))).alias("block"))
                   .withColumn("cell", F.monotonically_increasing_id()), "cell-signatures")
    block = F.pmod(F.xxhash64("cid"), F.ceil(F.col("m") / BLOCK)).cast("int")
    members = shuffle_join(shuffle_join(members, counts, "sig").withColumn("block", block), sigs.drop("m"), ["sig", "block"])
    cells = ws.save(_cells(members), "cells")
    # inverted lists: one entry per combination of shared pivots
    def listed(width: int) -> DataFrame:
        places = [[i for i in range(width) if mask >> i & 1] for mask in range(1 << width) if mask.bit_count() == min(shared, width)]
        combo = F.explode(F.array(*[F.array(*[F.element_at("sig", i + 1) for i in p]) for p in places]))
        return sigs.filter(F.size("sig") == width).select("cell", "sig", combo.alias("k"))

    lists = reduce(DataFrame.unionByName, map(listed, sorted(widths or {1})))
    met = (shuffle_join(lists.select(F.col("cell").alias("x"), F.col("sig").alias("sx"), "k"),
                        lists.select(F.col("cell").alias("y"), F.col("sig").alias("sy"), "k"), "k")
           .filter("x < y").filter(F.slice(F.array_intersect("sx", "sy"), 1, F.size("k")) == F.col("k")).select("x", "y"))
    pairs = ws.save(met, "met")
    ball = cells.select("cell", "centre", "radius")
    pairs = shuffle_join(pairs, ball.select(F.col("cell").alias("x"), F.col("centre").alias("cx"), F.col("radius").alias("rx")), "x")
    pairs = shuffle_join(pairs, ball.select(F.col("cell").alias("y"), F.col("centre").alias("cy"), F.col("radius").alias("ry")), "y")
    pairs = ws.save(_verdicts(pairs.select("x", "y", "cx", "rx", "cy", "ry"), cos), "pairs")
    body = cells.select("cell", "cids", "ns", "vecs")
    check = shuffle_join(pairs.filter("not all"), body.withColumnRenamed("cell", "x"), "x")
    check = shuffle_join(check, body.select(F.col("cell").alias("y"), F.col("cids").alias("cids2"), F.col("ns").alias("ns2"), F.col("vecs").alias("vecs2")), "y")
    found = ws.save(_inside(cells, cos).unionByName(_between(check, cos)).unionByName(_throughout(pairs.filter("all").select("x", "y"), cells)), "found")
    comp = connected_components(ws, found.filter("b is not null").select("a", "b"))
    least = shuffle_join(comp, classes.select(F.col("cid").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = shuffle_join(comp, least, "component").select(F.col("node").alias("cid"), "component_id")
    weight = found.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("w").alias("w"))
    final = ws.save(shuffle_join(shuffle_join(classes, named, "cid", "left"), weight, "cid", "left").select(
        "key", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "final")
    return shuffle_join(rows.select("vec_id", "key"), final, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
