"""Best-fit packing of token sequences by linear grouping.

A document has its ids and one end id; only documents longer than the capacity
are cut, into full pieces, the first one taking the remainder.  Pieces of equal
length are interchangeable, so the whole packing is decided on the histogram of
lengths (at most ``capacity`` rows, whatever the table's size):

1. large lengths are sorted and dealt into groups of equal cardinality, each
   rounded up to its longest member;
2. configurations of these few sizes are optimised by column generation (a
   knapsack over item counts prices the columns), then taken in whole numbers;
3. the actual documents take the slots of their group in descending order,
   which frees the room that rounding had added;
4. what is left over and all small pieces go, longest first, into the sequence
   with the least sufficient room.

The result is a list of runs, ``pieces lo..hi of length L go to sequences from
b on``; tasks number their pieces per length and look up the run.

Nulls: a null text is the empty text (the end id alone).  Repeated rows are
packed as often as they occur.  An empty table gives an empty result.  Texts
longer than a sequence are cut whole into pieces; pieces of equal length are
taken in the order of their tasks and rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoforge.llm.common import Workspace
from demoforge.llm.encode import PIECE_BYTES, library_encoder, slices

#: (share, groups): lengths above capacity / share are large and are dealt into
#: so many size groups.  Each choice is planned on the histogram; the one with
#: the fewest sequences is taken
CHOICES = ((2, 64), (3, 128), (4, 64))


def configurations(sizes: list[int], demand: list[int], capacity: int, limit: int = 4000) -> list[tuple[float, np.ndarray]]:
    """Fractional cutting-stock optimum: (how often, items of each size)."""
    m = len(sizes)
    s, d = np.array(sizes), np.array(demand, dtype=float)
    cols = [np.eye(m)[i] * (capacity // s[i]) for i in range(m)]
    at = np.arange(capacity + 1)[None, :] - s[:, None]
    most = capacity // int(s.min())
    for _ in range(limit):
        basis = np.array(cols).T
        x, y = np.linalg.solve(basis, d), np.linalg.solve(basis.T, np.ones(m))
        # knapsack by number of items: value[c] = best worth of exactly so many items in room c
        value, picks, best = np.zeros(capacity + 1), [], (1 + 1e-9, 0, 0)
        for k in range(most):
            worth = np.where(at >= 0, value[np.maximum(at, 0)], -np.inf) + y[:, None]
            pick = worth.argmax(axis=0)
            value = worth[pick, np.arange(capacity + 1)]
            picks.append(pick)
            if value[capacity] > best[0]:
                best = (value[capacity], k + 1, capacity)
        if not best[1]:
            break
        col, room = np.zeros(m), capacity
        for pick in reversed(picks[: best[1]]):
            col[pick[room]] += 1
            room -= s[pick[room]]
        step = np.linalg.solve(basis, col)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        cols[int(ratio.argmin())] = col
    x = np.linalg.solve(np.array(cols).T, d)
    return [(float(n), c.astype(int)) for n, c in zip(x, cols)]


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """The best of ``plan_with`` over ``CHOICES``."""
    return min((plan_with(histogram, capacity, *c) for c in CHOICES), key=lambda p: p[1])


def plan_with(histogram: dict[int, int], capacity: int, share: int, groups: int) -> tuple[np.ndarray, int]:
    """Runs (length, first piece, pieces, first sequence, offset, pieces a
    sequence) that hold every piece, and the number of sequences."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(histogram, 0)
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    rooms: list[int] = []
    n_bins = 0

    def opened(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_runs:
                open_runs[room] = []
                insort(rooms, room)
            open_runs[room].append((first, n))

    def take(length: int, n: int, first_bin: int, offset: int, per: int = 1) -> None:
        runs.append((length, taken[length], n, first_bin, offset, per))
        taken[length] += n

    if full := histogram.get(capacity, 0):
        take(capacity, full, 0, 0)
        n_bins = full
    large = sorted((x for x in histogram if capacity // share < x < capacity), reverse=True)
    total = sum(histogram[x] for x in large)
    if total:
        # groups of equal cardinality over the descending order of all large pieces
        each = -(-total // groups)
        stream, sizes, demand = [], [], []  # per merged size: [(length, pieces)] in descending order
        left = 0
        for x in large:
            n = histogram[x]
            while n:
                if not left:
                    left = each
                    if not sizes or sizes[-1] != x:
                        sizes.append(x)
                        demand.append(0)
                        stream.append([])
                k = min(n, left)
                demand[-1] += k
                stream[-1].append([x, k])
                n, left = n - k, left - k
        heads = [0] * len(sizes)

        def draw(g: int, n: int) -> list[tuple[int, int]]:
            got = []
            while n:
                item = stream[g][heads[g]]
                k = min(n, item[1])
                got.append((item[0], k))
                item[1] -= k
                n -= k
                heads[g] += not item[1]
            return got

        for times, items in configurations(sizes, demand, capacity):
            n = int(times + 1e-6)
            for g, a in enumerate(items):
                if a:
                    n = min(n, sum(k for _, k in stream[g]) // int(a))
            if n <= 0:
                continue
            slots = [draw(g, n) for g, a in enumerate(items) for _ in range(a)]
            # sequences in which every slot has one length
            edges = sorted({0, n, *(int(e) for s in slots for e in np.cumsum([k for _, k in s]))})
            at = [[0, 0] for _ in slots]  # run and pieces used of each slot
            for lo, hi in zip(edges, edges[1:]):
                used = 0
                for s, p in zip(slots, at):
                    length = s[p[0]][0]
                    take(length, hi - lo, n_bins + lo, used)
                    used += length
                    p[1] += hi - lo
                    if p[1] == s[p[0]][1]:
                        p[0], p[1] = p[0] + 1, 0
                opened(capacity - used, n_bins + lo, hi - lo)
            n_bins += n
    for x in sorted((x for x in histogram if x < capacity), reverse=True):
        n = histogram[x] - taken[x]
        while n:
            k = bisect_left(rooms, x)
            if k == len(rooms):
                per = capacity // x
                bins = max(1, n // per)
                opened(capacity, n_bins, bins)
                n_bins += bins
                k = len(rooms) - 1
            room = rooms[k]
            first, bins = open_runs[room].pop()
            per = min(room // x, n)
            use = min(bins, n // per)
            take(x, use * per, first, capacity - room, per)
            n -= use * per
            if not open_runs[room]:
                del open_runs[room]
                del rooms[k]
            opened(room, first + use, bins - use)
            opened(room - per * x, first, use)
    return np.array(runs, dtype=np.int64).reshape(-1, 6), n_bins


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth (number of the piece
    among the task's pieces of its length) and the ids if asked for."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    if with_ids:
        schema += ", ids binary"

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = library_encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        task, count = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for part in slices(batch, PIECE_BYTES):
                rows = []
                for d, t in zip(part.column("doc_id").to_pylist(), encoder.batch(part.column("text"))):
                    t += end
                    n = len(t) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        ids = t[4 * a:4 * b]
                        rows.append((d, k, a, b - a, zlib.crc32(ids), task, count[b - a], ids)[: 7 + with_ids])
                        count[b - a] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids]."""
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    pieces = ws.save(pieces_of(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    counts = ws.save(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    # at most `capacity` rows
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    runs, _ = plan(histogram, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast(runs)
    before = counts.selectExpr(
        "length", "task",
        "coalesce(sum(n) over (partition by length order by task rows between unbounded preceding and 1 preceding), 0) AS before")
    numbered = pieces.join(before, ["length", "task"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "task")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    numbered = numbered.select(*cols, "nth")

    def place(batches):
        import pyarrow as pa

        r = shared.value
        # the runs of a length follow each other without gaps
        own, begin = np.unique(r[:, 0], return_index=True)
        first, ends = dict(zip(own.tolist(), begin.tolist())), dict(zip(own.tolist(), [*begin[1:].tolist(), len(r)]))
        for b in batches:
            length = np.asarray(b.column("length"))
            nth = np.asarray(b.column("nth"))
            row = np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length).tolist():
                mine = length == x
                row[mine] = first[x] + np.searchsorted(r[first[x]:ends[x], 1], nth[mine], side="right") - 1
            k = nth - r[row, 1]
            per = r[row, 5]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in cols), pa.array(r[row, 3] + k // per), pa.array(r[row, 4] + (k % per) * length)],
                names=[*cols, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return numbered.mapInArrow(place, schema + (", ids binary" if with_ids else "") + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its concatenated ids (at most ``capacity`` of them)."""
    return (packed.groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids")))
