"""Concept distances, held-out concept draws and the concept split.

Minimum edit distance is a nearest-neighbour search over the *distinct*
concepts.  Neighbours in sorted order (of the texts and of the reversed texts)
give every concept an upper bound first.  Then a threshold d = 4, 8, 16, ...
deepens: a text cut into d + 1 segments keeps at least one of them, in place up
to a bounded shift, in every text within d edits, so a concept meets others
through an equi-join on (length, segment number, segment) and the survivors go
through the bounded ``levenshtein(a, b, t)``, t = d or just below the upper bound.
A concept is final once a match at or below d is found, or its upper bound is at
most d + 1; only the others go on.  Where the probes of d + 1 segments would cost more than meeting every
concept (few concepts, or the last few with a large d), the concepts left meet
all of similar length instead, in length bands cut into a grid of cells.  ``report`` tells how many pairs every round compared.

Spark sizes an exploded table like the file below it, so it is counted here what
a join would broadcast: the index of a round goes to every task up to
``BROADCAST_BYTES``, a larger one meets the probes in a sort-merge join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demoforge.functions.draws import draw, draw_hash
from demoforge.operators.windows import dense_index
from demoforge.session import cut_lineage

START_THRESHOLD = 4
PROBE_COST = 16  # bounded comparisons that cost about as much as a probe with its join
PAIRS_PER_TASK = 10_000_000  # bounded-threshold comparisons one task should run per cell of a band
CELL_BYTES = 32_000_000  # of one side that a task holds at a time
BROADCAST_BYTES = 4_000_000
ROW_BYTES = 64  # of a row besides its texts


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _row_bytes(length: int) -> int:
    """Of a row with a text of ``length`` characters of up to 4 bytes."""
    return 4 * length + ROW_BYTES


def _on_text(df: DataFrame, other: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join with a table of texts, which is never broadcast: a file of
    repeated texts says little about the bytes it holds."""
    return df.join(other.hint("merge"), on, how)


def _band_sides(hist: dict[int, int], width: int, parts: int):
    """Parts of either side of a length band for one round, as a literal map.

    Right side of band b: concepts with length // width == b; left side: at
    most those of bands b-1..b+1.  Each of n parts of a side meets each of the
    other, in n * n cells, as many as its comparisons (budget: the round's
    total over ~4 cells per partition, capped by PAIRS_PER_TASK) and bytes
    (CELL_BYTES a part) ask for; quiet bands keep one cell (no copies)."""
    right: dict[int, int] = {}
    held: dict[int, int] = {}
    for length, n in hist.items():
        right[length // width] = right.get(length // width, 0) + n
        held[length // width] = held.get(length // width, 0) + n * _row_bytes(length)
    cmp = {b: n * sum(right.get(b + k, 0) for k in (-1, 0, 1)) for b, n in right.items()}
    total = sum(cmp.values())
    budget = min(float(PAIRS_PER_TASK), max(1.0, total / (4.0 * parts)))
    sides = {b: max(math.ceil(math.sqrt(c / budget)), math.ceil(held[b] / CELL_BYTES)) for b, c in cmp.items()}
    kv = [x for b, n in sorted(sides.items()) if n > 1 for x in (F.lit(b).cast("bigint"), F.lit(n))]
    return F.create_map(*kv) if kv else None


def _band_pairs(remaining: DataFrame, others: DataFrame, hist: dict[int, int], d: int, parts: int) -> DataFrame:
    """Pairs whose lengths differ by at most the concept's own ``t`` <= d."""
    width = d + 1
    left = remaining.withColumn("_band", F.explode(F.array(*[F.floor(F.col("la") / width) + k for k in (-1, 0, 1)])))
    right = others.withColumn("_band", F.floor(F.col("lb") / width))
    if sum(n * _row_bytes(length) for length, n in hist.items()) <= BROADCAST_BYTES:
        met = left.join(F.broadcast(right), "_band")
    else:
        sides = _band_sides(hist, width, parts)
        n_of = F.coalesce(F.try_element_at(sides, F.col("_band").cast("bigint")), F.lit(1)) if sides is not None \
            else F.lit(1)
        each = F.explode(F.sequence(F.lit(0), n_of - 1))
        cell = ["_band", "_i", "_j"]
        # a fixed number of partitions: few bytes here are many comparisons
        left = left.withColumn("_i", F.pmod(F.xxhash64("a"), n_of).cast("int")).withColumn("_j", each).repartition(2 * parts, *cell)
        right = right.withColumn("_j", F.pmod(F.xxhash64("b"), n_of).cast("int")).withColumn("_i", each).repartition(2 * parts, *cell)
        met = left.hint("merge").join(right, cell)
    return met.where(F.abs(F.col("la") - F.col("lb")) <= F.col("t")).select("a", "b", "t")


def probes_of(d: int) -> int:
    """Probes of a long text in a round: its substrings that can stand for a
    segment of a text within d edits."""
    # the sum of min(i, shift + d - i) + min(i, d - i - shift) + 1 over segments i and shifts up to d
    return 2 * d * (d + 1) * (d - 1) // 3 + (2 * d + 1) * (d + 1)


def _segment_pairs(remaining: DataFrame, others: DataFrame, hist: dict[int, int], d: int) -> DataFrame:
    """Pairs (a, b), some more than once, with every b within the concept's own
    ``t`` <= d edits of a.

    Segment i of b starts at ``i * lb div (d + 1)``.  One of the first t + 1 has
    i edits before it, none inside and at most t - i behind it, so it starts in
    a at most i places from its start and, counted from the ends, at most t - i
    places from there.  A text of at most d characters has no d + 1 segments
    and meets every text of at most t characters more or less."""
    k = d + 1
    first = F.floor(F.col("i") * F.col("lb") / k).cast("int")
    size = (F.floor((F.col("i") + 1) * F.col("lb") / k) - first).cast("int")
    index = others.where(F.col("lb") >= k).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(d)))).select(
        "b", "lb", "i", F.substring(F.col("b"), first + 1, size).alias("seg"))
    shift = F.col("la") - F.col("lb")
    lo = F.greatest(F.lit(0), F.col("s") - F.col("i"), F.col("s") + shift - (F.col("t") - F.col("i")))
    hi = F.least(F.col("la") - F.col("n"), F.col("s") + F.col("i"), F.col("s") + shift + (F.col("t") - F.col("i")))
    probes = remaining.where((F.col("la") > 0) & (F.col("la") + F.col("t") >= k)).select(
        "a", "la", "t", F.explode(F.sequence(F.greatest(F.col("la") - F.col("t"), F.lit(k)), F.col("la") + F.col("t"))).alias("lb"))
    probes = probes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("t")))).withColumn("s", first).withColumn("n", size)
    probes = probes.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn(
        "_p", F.explode(F.sequence("_lo", "_hi"))).select("a", "t", "lb", "i", F.substring(F.col("a"), F.col("_p") + 1, F.col("n")).alias("seg"))
    small = sum(n * k * _row_bytes(length) for length, n in hist.items() if length >= k) <= BROADCAST_BYTES
    pairs = probes.join(F.broadcast(index) if small else index.hint("merge"), ["lb", "i", "seg"]).select("a", "b", "t")
    short = remaining.where(F.col("la") - F.col("t") <= d).select(
        "a", "t", F.explode(F.sequence(F.greatest(F.col("la") - F.col("t"), F.lit(0)), F.least(F.col("la") + F.col("t"), F.lit(d)))).alias("lb"))
    return pairs.unionByName(_on_text(short, others.where(F.col("lb") <= d), "lb").select("a", "b", "t"))


def _upper_bounds(concepts: DataFrame, parts: int) -> DataFrame:
    """``concepts`` with ``most``: the distance to the nearest of the sorted
    neighbours, of the texts and of the reversed texts (NULL without any).
    Neighbours across a border of the sorted parts are not looked at."""
    for name, key in (("_m0", F.col("a")), ("_m1", F.reverse("a"))):
        sorted_ = concepts.withColumn("_key", key).repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id())
        w = Window.partitionBy("_part").orderBy("_key")
        near = F.least(F.levenshtein(F.col("a"), F.lag("a").over(w)), F.levenshtein(F.col("a"), F.lead("a").over(w)))
        concepts = sorted_.withColumn(name, near).drop("_key", "_part")
    return concepts.withColumn("most", F.least("_m0", "_m1").cast("bigint")).drop("_m0", "_m1")


def min_edit_distance(df: DataFrame, col: str = "concept", start: int = START_THRESHOLD,
                      report: list[dict] | None = None) -> DataFrame:
    """``(col, min_dist)``: smallest Levenshtein distance from each distinct
    value to any other distinct value; NULL for a value with no other.
    ``report`` gets a dict a round: threshold, way, concepts left, pairs
    compared."""
    parts = _partitions(df)
    # written first: each range partitioning of the bounds runs its input twice
    concepts = cut_lineage(df.select(F.col(col).alias("a")).where(F.col("a").isNotNull()).distinct()
                           .withColumn("la", F.char_length("a")))
    concepts = cut_lineage(_upper_bounds(concepts, parts))
    # length histogram: at most max_len + 1 rows, read once
    hist = {int(r["la"]): int(r["n"]) for r in concepts.groupBy("la").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not hist:
        return df.sparkSession.createDataFrame([], f"{col} STRING, min_dist BIGINT")
    total, max_len = sum(hist.values()), max(hist)
    others = concepts.select(F.col("a").alias("b"), F.col("la").alias("lb"))
    remaining, left = concepts, total
    found: list[DataFrame] = []
    d = start
    while left:
        by_segments = PROBE_COST * probes_of(d) < total
        # only what is nearer than the bound is looked for, and no two are 0 apart
        asked = remaining.withColumn("t", F.least(F.lit(d), F.col("most") - 1).cast("int")).where("t > 0")
        pairs = _segment_pairs(asked, others, hist, d) if by_segments else _band_pairs(asked, others, hist, d, parts)
        dist = pairs.where("a <> b").select("a", F.expr("levenshtein(a, b, t)").alias("dist"))
        # -1: more than t; counted, but no match
        best = cut_lineage(dist.groupBy("a").agg(
            F.min(F.when(F.col("dist") >= 0, F.col("dist"))).cast("bigint").alias("dist"), F.count(F.lit(1)).alias("compared")))
        state = cut_lineage(_on_text(remaining, best, "a", "left"))
        # nothing nearer than the bound is left out when all within d were met
        done = F.col("dist").isNotNull() | (F.col("most") <= d + 1)
        found.append(state.where(done).select("a", F.least("dist", "most").alias("min_dist")))
        stats = state.agg(F.sum("compared").alias("c"), F.count(F.when(~F.coalesce(done, F.lit(False)), 1)).alias("n")).first()
        if report is not None:
            report.append({"threshold": d, "way": "segments" if by_segments else "bands", "concepts": left,
                           "compared": int(stats["c"] or 0)})
        remaining, left = state.where(~F.coalesce(done, F.lit(False))).select("a", "la", "most"), int(stats["n"])
        if d >= max_len:
            break
        d *= 2
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    lone = remaining.select("a", F.lit(None).cast("bigint").alias("min_dist"))
    return out.unionByName(lone).withColumnRenamed("a", col)


def indexed_by_hash(df: DataFrame, col: str, by: Sequence[str] = (), seed: str = "order") -> DataFrame:
    """Dense positions in a seeded hash order (ties by value), per ``by``."""
    keyed = df.withColumn("_h", draw_hash(F.lit(seed), F.col(col)))
    return dense_index(keyed, "_h", by=list(by), out="pos", size_out="n", tiebreak=[col]).drop("_h")


def draw_concepts(distances: DataFrame, bands: Sequence[int], m: int, seed: int | str = 0,
                  col: str = "concept") -> DataFrame:
    """``m`` draws with replacement among the concepts at each distance in
    ``bands``: ``(band, j, concept)``.  The pick table is bands x m rows
    (parameters), broadcast against the indexed concepts."""
    spark = distances.sparkSession
    at = distances.where(F.col("min_dist").isin(list(bands))).select(col, F.col("min_dist").alias("band"))
    idx = indexed_by_hash(at, col, by=["band"])
    sizes = idx.select("band", "n").distinct()
    picks = spark.range(len(bands) * m).select(
        F.element_at(F.array(*[F.lit(b) for b in bands]), (F.floor(F.col("id") / m) + 1).cast("int")).alias("band"),
        F.pmod(F.col("id"), F.lit(m)).alias("j"))
    picks = picks.join(F.broadcast(sizes), "band").withColumn(
        "pos", draw(F.lit(str(seed)), F.col("band"), F.col("j"), n=F.col("n")))
    return picks.join(idx.select("band", "pos", col), ["band", "pos"]).select("band", "j", col)


def concept_split(concepts: DataFrame, bands: Sequence[int], m: int, seed: int | str = 0,
                  col: str = "concept", distances: DataFrame | None = None) -> DataFrame:
    """Per distinct concept: its min distance and ``heldout`` or ``train``
    (train = all concepts except the drawn ones)."""
    all_c = cut_lineage(concepts.select(col).distinct())
    dist = distances if distances is not None else min_edit_distance(all_c, col)
    held = draw_concepts(dist, bands, m, seed, col).select(col).distinct()
    train = all_c.subtract(held)
    marked = dist.join(held.withColumn("split", F.lit("heldout")), col, "left")
    return (_on_text(marked, train.withColumn("_t", F.lit(1)), col, "left")
            .select(col, "min_dist", F.coalesce("split", F.when(F.col("_t") == 1, "train")).alias("split")))
