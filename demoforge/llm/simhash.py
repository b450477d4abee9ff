"""SimHash near duplicates through a generalised pigeonhole join.

Fingerprint: 64 majority bits over the XXH64 (seed 42) of all word shingles.
Different fingerprints are joined as follows.

* Correlated bits are put into the same partition of the 64 bits, so that
  partitions differ from each other in what they tell.
* Partition i gets a threshold t_i (-1: not probed) with sum(t) = tau - m + 1;
  if every partition differed by more than its threshold, the whole would
  differ by more than tau.  Dynamic programming picks the thresholds, for each
  number m of partitions, by signatures to enumerate plus estimated candidates
  (exact collision counts of the partition's values, extended to larger
  distances by the bits' disagreement rates); the cheapest m is taken.
* Every fingerprint files itself under its partition values and probes all
  values within t_i.  Values met by two or more are verified on all 64 bits.

Verification returns a spanning forest of a value's links, never all pairs.  A
value shared by more than ``GROUP_ROWS`` fingerprints is not verified in one
task: two fingerprints differ by at most two bits exactly if some word lies
within one bit of both, so its members are filed under their 65 words within
one bit, and all members of a word (65 at most) hang on the least one.

Nulls: a null text is the empty text; texts without words have fingerprint zero
and are linked like any other.  Repeated rows share a component.  A null doc_id
never names a component unless all ids of it are null.  An empty table gives an
empty result.  Texts are read whole, whatever their length.  ``components``
ignores other columns, ``near_dedup`` carries them, names of its own work
included.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoforge.llm.caches import drop
from demoforge.llm.common import Workspace, connected_components, join_ids, key_groups
from demoforge.llm.encode import slices, texts_of

SHINGLE_WORDS = 3
MAX_BITS = 2
#: fingerprints of one value that a task compares with each other
GROUP_ROWS = 2048


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) < words:
        spans = [(0, len(line))]
    else:
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(w) - words + 1].tolist(), ends[words - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], 42) for a, b in spans], dtype="<u8")
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65_536):
        bits = np.unpackbits(h[k:k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long); no shuffle."""

    def run(batches):
        import pyarrow as pa

        drop()
        for batch in batches:
            for piece in slices(batch):
                fp = np.array([fingerprint(t, words) for t in texts_of(piece.column("text"))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and the 64 x 64 table of how often two bits are both set."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((64, 64), dtype=np.int64)
        for batch in batches:
            b = _bits(np.asarray(batch.column("fp"))).astype(np.float32)
            total += (b.T @ b).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], names=["k", "n"])

    both = np.zeros(4096)
    for k, n in fps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        both[k] = n
    return fps.count(), both.reshape(64, 64)


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m sets of bits; each grows by the bit most correlated with it."""
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(64)), []
    for k in range(m):
        size = -(-len(free) // (m - k))
        rest = sorted(free)
        part = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            b = max(sorted(free), key=lambda x: (corr[x, part].sum(), -x))
            part.append(b)
            free.remove(b)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (cost[i][t + 1] for t = -1, 0, ..) with the given sum and
    least cost, by dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, start=-1):
                if s + t not in nxt or c + x < nxt[s + t][0]:
                    nxt[s + t] = (c + x, [*ts, t])
        best = nxt
    return best[total]


def _values(fp: np.ndarray, part: list[int]) -> np.ndarray:
    bits = _bits(fp)[:, part].astype(np.int64)
    return (bits << np.arange(len(part), dtype=np.int64)).sum(axis=1)


def choose(fps: DataFrame, tau: int) -> tuple[list[list[int]], list[int]]:
    """Partitions of the bits and their thresholds."""
    n, both = bit_statistics(fps)
    options = {m: correlated_partitions(n, both, m) for m in range(2, tau + 2)}
    flat = [(m, i, part) for m, parts in options.items() for i, part in enumerate(parts)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            for k, (_, _, part) in enumerate(flat):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(_values(fp, part))], names=["k", "v"])

    same = fps.select("fp").mapInArrow(run, "k int, v long").groupBy("k", "v").agg(F.count("*").cast("double").alias("c"))
    pairs = {r[0]: r[1] for r in same.groupBy("k").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).collect()}
    p = both.diagonal() / max(n, 1)
    differ = 2 * p * (1 - p)
    best = None
    for m, parts in options.items():
        costs = []
        for i, part in enumerate(parts):
            # distribution of the partition's distance for independent bits
            dist = np.zeros(tau + 2)
            dist[0] = 1
            for b in part:
                dist[1:] = dist[1:] * (1 - differ[b]) + dist[:-1] * differ[b]
                dist[0] *= 1 - differ[b]
            exact = max(pairs.get(flat.index((m, i, part)), 0.0), n * n / 2 * dist[0])
            row, signatures = [0.0], 0
            for t in range(tau + 1):
                signatures += comb(len(part), t)
                near = exact * dist[: t + 1].sum() / max(dist[0], 1e-300)
                row.append(n * signatures + min(near, n * n / 2))
            costs.append(row)
        cost, ts = allocate(costs, tau - m + 1)
        if best is None or cost < best[0]:
            best = (cost, parts, ts)
    return best[1], best[2]


def links(ws: Workspace, fps: DataFrame, tau: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of different fingerprints within tau bits that connect the
    same fingerprints as all such pairs do."""
    if tau > 2:
        raise ValueError("values with many members are split for up to two bits")
    parts, thresholds = choose(fps, tau)

    def probes(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            for i, (part, t) in enumerate(zip(parts, thresholds)):
                v = _values(fp, part)
                for k in range(t + 1):
                    for flips in combinations(range(len(part)), k):
                        mask = sum(1 << f for f in flips)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(fp), i, np.int32)), pa.array(v ^ mask), batch.column("fp"),
                             pa.array(np.full(len(fp), k == 0))], names=["part", "value", "fp", "own"])

    keys = fps.select("fp").mapInArrow(probes, "part int, value long, fp long, own boolean")
    met = ws.save(keys.groupBy("part", "value").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("owners"))
                  .filter("n > 1 and owners > 0").select("part", "value", "n"), "met")
    rows = keys.join(met, ["part", "value"])

    def verify(batches):
        import pyarrow as pa

        a, b = [], []
        for _, g in key_groups(batches, ["part", "value"]):
            fp, own = g["fp"].astype(np.uint64), g["own"]
            near = np.bitwise_count(fp[own][:, None] ^ fp[None, :]) <= tau
            at = np.flatnonzero(own)
            seen = np.zeros(len(fp), dtype=bool)
            todo = list(range(len(at)))
            done = np.zeros(len(at), dtype=bool)
            for root in todo:
                if done[root]:
                    continue
                stack = [root]
                done[root] = True
                seen[at[root]] = True
                while stack:
                    i = stack.pop()
                    new = near[i] & ~seen
                    # a probe may meet several owners: it is linked with each component once
                    seen |= new & own
                    for j in np.flatnonzero(new):
                        a.append(fp[at[i]])
                        b.append(fp[j])
                        if own[j]:
                            k = int(np.searchsorted(at, j))
                            done[k] = True
                            stack.append(k)
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    found = (rows.filter(F.col("n") <= GROUP_ROWS).select("part", "value", "fp", "own")
             .repartition("part", "value").sortWithinPartitions("part", "value").mapInArrow(verify, "a long, b long"))
    edges = ws.save(found.filter("a <> b").distinct(), "links")
    if met.filter(F.col("n") > GROUP_ROWS).isEmpty():
        return edges
    crowd = ws.save(rows.filter(F.col("n") > GROUP_ROWS).select("fp").distinct(), "crowd")
    word = F.expr("explode(concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b))))")
    words = crowd.select("fp", word.alias("word"))
    least = ws.save(words.groupBy("word").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1").select("word", "least"), "words")
    hung = words.join(least, "word").select(F.col("fp").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
    return ws.save(edges.unionByName(hung), "links")


def components(docs: DataFrame, words: int = SHINGLE_WORDS, tau: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    that links reach) for every row."""
    ws = Workspace(docs.sparkSession, "simhash")
    d = ws.save(fingerprints(docs, words), "fingerprints")
    fps = ws.save(d.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = connected_components(ws, links(ws, fps, tau))
    named = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = ws.save(named, "named")
    # only components of several fingerprints need their least document
    many = named.join(comp.select("component").distinct(), "component", "left_semi")
    least = ws.save(many.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    final = ws.save(named.join(least, "component", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "final")
    return d.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay: of each component the document with the smallest id.
    Rows of one doc_id stay or go together (they stay if any of them would);
    rows with a null doc_id stay."""
    ws = Workspace(docs.sparkSession, "simhash-dedup")
    found = ws.save(components(docs).select("doc_id", "component_id"), "components")
    stays = found.filter("doc_id = component_id").select("doc_id").distinct()
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct().join(stays, "doc_id", "left_anti")
    return join_ids(docs, ws.save(gone, "dropped"), ["doc_id"], "left_anti")
