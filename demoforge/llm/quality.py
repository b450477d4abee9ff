"""Quality by ordinal cumulative-link regression on graded ratings.

With ordered grades g0 < g1 < .. a text x is rated above grade k with
probability sigmoid(w x - theta_k): the weights of hashed text features are
shared by all grades, the thresholds theta are ordered.  From these follow the
expected grade and the tail probability of reaching a wanted grade.

Features of a text are the shares of its words' lower-cased forms, shapes (runs
of letters, capitals, digits and each other character), pairs of neighbouring
shapes, and words that repeat the one before, each hashed to one of ``SLOTS``.

The fit uses at most ``FIT_ROWS`` labelled rows (the least by a hash of doc_id),
none with crc32(doc_id as text) mod 5 = 0, which stay for testing.

Nulls: a null text is the empty text; a text without words has only the
thresholds.  Null grades are not learned from; of several grades for a doc_id
the greatest counts.  Without two different grades every row gets the one grade
known, or null, and is kept.  Empty tables and repeated rows need no special
case.  Texts are graded whole, whatever their length; a word counts by its form
and by its shape, of which the first 8 signs are looked at.  ``select_quality``
carries all columns.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from demoforge.llm.caches import held
from demoforge.llm.chars import WordTable
from demoforge.llm.common import Workspace, fresh
from demoforge.llm.encode import slices, texts_of
from demoforge.llm.toxicity import fold, labelled

SLOTS = 1 << 18
FIT_ROWS = 10_000
EPOCHS = 12
_RUNS = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "T" if m[0][0].isupper() else "a"),
         (re.compile(r"\d+"), lambda m: "0"))


def shape(word: str) -> str:
    for pattern, name in _RUNS:
        word = pattern.sub(name, word)
    return word[:8]


def _word_slots(words: list[str]) -> np.ndarray:
    """Slots of a word's form and shape, and the shape's hash."""
    out = np.zeros((len(words), 3))
    shapes: dict[str, int] = {}
    for i, w in enumerate(words):
        s = shape(w)
        h = shapes.get(s)
        if h is None:
            h = shapes[s] = zlib.crc32(s.encode("utf-8", "surrogatepass"))
        out[i] = zlib.crc32(b"w" + w.lower().encode("utf-8", "surrogatepass")) % SLOTS, h % SLOTS, h
    return out


_REPEAT = zlib.crc32(b"\x00repeat") % SLOTS


def feature_slots(texts: list[str]) -> list[np.ndarray]:
    """The slots of each text's features, one for each occurrence."""
    out, table = [], held("quality", lambda: WordTable(_word_slots, 3))
    for at in table.batch([t.split() for t in texts]):
        rows = table.rows[at].astype(np.int64)
        pair = (rows[:-1, 2] * 0x9E3779B1 + rows[1:, 2] * 0x85EBCA77) % SLOTS
        again = np.full(int((at[1:] == at[:-1]).sum()), _REPEAT)
        out.append(np.concatenate([rows[:, 0], rows[:, 1], pair, again]))
    return out


class Ordinal:
    """Weights and ordered thresholds."""

    def __init__(self, grades: list[float], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    @classmethod
    def fit(cls, slots: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], grades: list[float], seed: int = 0) -> Ordinal:
        """Adam on the likelihood; texts come as (slots, counts) and their number
        of words."""
        known = sorted(set(grades))
        y = np.array([known.index(g) for g in grades])
        k = len(known) - 1
        rate = np.clip(np.array([(y > j).mean() for j in range(k)]), 1e-3, 1 - 1e-3)
        theta = np.log((1 - rate) / rate)
        gaps = np.log(np.maximum(np.diff(theta), 1e-3))
        w = np.zeros(SLOTS)
        first = theta[0]
        m, v = np.zeros(SLOTS + k), np.zeros(SLOTS + k)
        rng, step = np.random.RandomState(seed), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for a in range(0, len(y), 256):
                rows = order[a:a + 256]
                size = np.array([len(slots[i][0]) for i in rows])
                at = np.concatenate([slots[i][0] for i in rows])
                doc = np.repeat(np.arange(len(rows)), size)
                value = np.concatenate([slots[i][1] for i in rows]) / np.repeat(np.maximum([sizes[i] for i in rows], 1), size)
                z = np.bincount(doc, weights=w[at] * value, minlength=len(rows))
                theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
                above = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -30, 30)))  # P(y > j)
                full = np.column_stack([np.ones(len(rows)), above, np.zeros(len(rows))])
                mine = np.arange(len(rows))
                p = np.maximum(full[mine, y[rows]] - full[mine, y[rows] + 1], 1e-9)
                slope = np.column_stack([np.zeros(len(rows)), above * (1 - above), np.zeros(len(rows))])
                up, down = slope[mine, y[rows]] / p, slope[mine, y[rows] + 1] / p
                dz = (up - down) / len(rows)
                dtheta = np.zeros(k + 2)
                np.add.at(dtheta, y[rows], -up / len(rows))
                np.add.at(dtheta, y[rows] + 1, down / len(rows))
                dtheta = dtheta[1:k + 1]
                tail = np.cumsum(dtheta[::-1])[::-1]
                grad = np.concatenate([np.bincount(at, weights=dz[doc] * value, minlength=SLOTS), tail[:1], tail[1:] * np.exp(gaps)])
                step += 1
                m = 0.9 * m + 0.1 * grad
                v = 0.99 * v + 0.01 * grad * grad
                change = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
                w += change[:SLOTS]
                w *= 1 - 1e-4
                first += change[SLOTS]
                gaps += change[SLOTS + 1:]
        return cls([float(g) for g in known], w.astype(np.float32), first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))

    def above(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        z = np.array([self.weights[s].sum(dtype=float) / max(len(t.split()), 1) for s, t in zip(feature_slots(texts), texts)])
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -700, 700)))


def _sample_features(rows: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch):
                texts = texts_of(piece.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("y"), pa.array([len(t.split()) for t in texts], pa.int32()),
                     pa.array([x.astype("<u4").tobytes() for x in feature_slots(texts)], pa.binary())], names=["doc_id", "y", "words", "slots"])

    return rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y double, words int, slots binary")


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality") -> Ordinal | list[float]:
    """The model, or the list of grades when there are fewer than two."""
    ws = Workspace(docs.sparkSession, "quality")
    labels = labels.filter(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col(grade).cast("double")).alias("y")).filter(fold(F.col("doc_id"), 5) != 0)
    sample = ws.save(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS), "sample")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = ws.save(_sample_features(labelled(docs, sample)), "features").orderBy("doc_id", F.xxhash64("slots"))
    y, words, slots = [], [], []
    for r in rows.toLocalIterator():
        at, n = np.unique(np.frombuffer(r["slots"], "<u4"), return_counts=True)
        y.append(r["y"])
        words.append(r["words"])
        slots.append((at.astype(np.int32), n.astype(np.float32)))
    if len(set(y)) < 2:
        return sorted(set(y))
    return Ordinal.fit(slots, words, y)


def grade(docs: DataFrame, labels: DataFrame, expected: str, tail: str, column: str = "quality", wanted: float = 1.0) -> DataFrame:
    """All columns of ``docs`` with the expected grade and the probability of a
    grade of ``wanted`` or more under the given new names."""
    model = fit(docs, labels, column)
    if isinstance(model, list):
        known = F.lit(model[0] if model else None).cast("double")
        return docs.withColumn(expected, known).withColumn(tail, F.coalesce((known >= wanted).cast("double"), F.lit(1.0)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    steps = np.diff(model.grades)
    # P(grade >= wanted) is the tail above the last grade below it
    below = sum(g < wanted for g in model.grades)
    schema = StructType([*docs.schema.fields]).add(expected, DoubleType()).add(tail, DoubleType())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch):
                m = shared.value
                p = m.above(texts_of(piece.column("text")))
                above = np.ones(len(p)) if below == 0 else np.zeros(len(p)) if below == len(m.grades) else p[:, below - 1]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(m.grades[0] + p @ steps), pa.array(above)], names=[*piece.schema.names, expected, tail])

    return docs.mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, kept for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return grade(rows, labels, "expected_grade", "tail_probability").select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "expected_grade", "tail_probability",
        (F.col("tail_probability") >= cut).alias("kept"))


def select_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows whose probability of the wanted grade is at least ``cut``."""
    expected, tail = fresh(docs, "_expected"), fresh(docs, "_tail")
    return grade(docs, labels, expected, tail).filter(F.col(tail) >= cut).drop(expected, tail)
