"""Toxicity by class-conditional Kneser-Ney models over characters in words.

Each class has its own counts of the next character after up to ``ORDER - 1``
characters of the word; all lower orders are continuation counts shared by both
classes, so an expression that a class has not seen backs off to the same
distribution in both.  Backing off, the shared part cancels from the ratio of
the two likelihoods, so the model that scores is one number for each seen
n-gram and one for each context, keyed by 64-bit hash.  The entries are counted:
up to ``GATHER`` of them are broadcast, more stay tables, with which the
different words of the texts are joined (words -> n-grams -> ratios -> words).

Counts come from every labelled training row.  A word's log-likelihood ratio is
the sum over its characters; a text is compared length-normalised, as a whole
and in its most suspicious run of ``RUN`` words, and a logistic curve turns the
two numbers into a score.  The curve is fitted with a first model, which has no
counts from fold 1, on rows of fold 1 (at most ``CALIBRATION_ROWS``); the model
that scores then counts fold 1, too.

Nulls: a null text is the empty text, which scores as the curve says for zero
evidence.  Rows without a label are not learned from; a doc_id labelled more
than once counts as toxic if any label says so.  Without labels of both classes
every score is the share of toxic labels (0 without any).  Empty tables and
repeated rows need no special case.  Texts are scored whole, whatever their
length; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demoforge.llm.chars import END, START, WordTable, framed, gram_hashes, words_of
from demoforge.llm.common import BROADCAST_IDS, Workspace
from demoforge.llm.encode import slices, texts_of

ORDER = 6
DISCOUNT = 0.75
#: a model of at most so many n-grams and contexts is broadcast
GATHER = 1 << 22
#: parts of the n-grams that a large share of the words starts with
SALTS = 32
RUN = 3
CALIBRATION_ROWS = 20_000
#: code points that the lowest order spreads over
ALPHABET = 1 << 10


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and label of labelled rows; a label list of counted size is broadcast."""
    if labels.count() <= BROADCAST_IDS:
        labels = F.broadcast(labels)
    return docs.join(labels, "doc_id")


def _word_counts(rows: DataFrame) -> DataFrame:
    """(text, y) -> word, c0, c1."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 4_000_000):
                count = (Counter(), Counter())
                for t, y in zip(texts_of(piece.column("text")), piece.column("y").to_pylist()):
                    count[y].update(words_of(t))
                words = list(count[0].keys() | count[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in count)], names=["word", "c0", "c1"])

    return rows.mapInArrow(run, "word string, c0 long, c1 long").groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _grams(words: DataFrame) -> DataFrame:
    """Counts of the n-grams of the highest order (shorter at a word's start)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            c0, c1 = Counter(), Counter()
            for w, a, z in zip(*(b.column(c).to_pylist() for c in ("word", "c0", "c1"))):
                s = START + w + END
                for i in range(1, len(s)):
                    g = s[max(0, i - ORDER + 1):i + 1]
                    c0[g] += a
                    c1[g] += z
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c0), pa.string()), pa.array(list(c0.values()), pa.int64()), pa.array([c1[g] for g in c0], pa.int64())], names=["g", "c0", "c1"])

    return words.mapInArrow(run, "g string, c0 long, c1 long").groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _shared(ws: Workspace, grams: DataFrame) -> DataFrame:
    """t, p: Kneser-Ney probability of the last character of t after the others,
    from the number of different characters before t in either class."""
    n = F.char_length("g")
    tails = grams.select(F.explode(F.expr("transform(sequence(0, length(g) - 1), i -> substring(g, i + 1))")).alias("g")).distinct()
    cont = tails.filter(n > 1).groupBy(F.expr("substring(g, 2)").alias("t")).agg(F.count("*").alias("k"))
    cont = cont.withColumn("c", F.expr("substring(t, 1, length(t) - 1)"))
    ctx = cont.groupBy("c").agg(F.sum("k").alias("n"), F.count("*").alias("types"))
    cont = ws.save(cont.join(ctx, "c").select(
        "t", (F.greatest(F.col("k") - DISCOUNT, F.lit(0.0)) / F.col("n")).alias("own"), (F.lit(DISCOUNT) * F.col("types") / F.col("n")).alias("rest")), "continuations")
    level = cont.filter(F.char_length("t") == 1).select("t", (F.col("own") + F.col("rest") / ALPHABET).alias("p"))
    out = level = ws.save(level, "shared")
    for k in range(2, ORDER):
        below = level.select(F.col("t").alias("s"), "p")
        ws.release()
        level = ws.save(cont.filter(F.char_length("t") == k).withColumn("s", F.expr("substring(t, 2)")).join(below, "s")
                        .select("t", (F.col("own") + F.col("rest") * F.col("p")).alias("p")), "shared")
        out = out.unionByName(level)
    return out


def _hashes(strings: list[str], context: bool) -> np.ndarray:
    """Hash of each n-gram, or of each context, given with its word start if it has one."""
    data = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.array([len(s) for s in strings], dtype=np.int64)
    end = np.cumsum(size)
    return gram_hashes(data, end - size, ORDER - context)[end - 1].view(np.int64)


def _table(rows: DataFrame, key: str, context: bool) -> DataFrame:
    """(key, ratio) -> h, ratio; one row for each key."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(b.column(key).to_pylist(), context)), b.column("ratio")], names=["h", "ratio"])

    return rows.select(key, F.col("ratio").cast("float").alias("ratio")).mapInArrow(run, "h long, ratio float")


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = table.toArrow()  # without a Python object for each row
    h, ratio = t["h"].to_numpy().astype(np.int64), t["ratio"].to_numpy().astype(np.float32)
    order = np.argsort(h, kind="stable")
    return h[order], ratio[order]


def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, missing: float) -> np.ndarray:
    if not len(table[0]):
        return np.full(len(h), missing)
    at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
    return np.where(table[0][at] == h, table[1][at], missing)


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each framed word; for each place the hashes of its n-gram and of
    the context before it (which means nothing at a start)."""
    data, start = framed(words)
    full, short = (gram_hashes(data, start, k).view(np.int64) for k in (ORDER, ORDER - 1))
    return start, full, np.concatenate([short[:1], short[:-1]])


class Model:
    """Log-likelihood ratios of words, toxic over ordinary, from (hash, ratio)
    of n-grams and of contexts, sorted by hash."""

    def __init__(self, gram: tuple[np.ndarray, np.ndarray], context: tuple[np.ndarray, np.ndarray]):
        self.gram, self.context, self.memo = gram, context, None

    def __getstate__(self):
        return {"gram": self.gram, "context": self.context, "memo": None}

    def words(self, words: list[str]) -> np.ndarray:
        start, full, before = _places(words)
        ratio = _find(self.gram, full, np.nan)
        ratio = np.where(np.isnan(ratio), _find(self.context, before, 0.0), ratio)
        ratio[start] = 0
        return np.add.reduceat(ratio, start)[:, None]

    def features(self, texts: list[str]) -> np.ndarray:
        """Mean ratio per word of the text and of its highest run of words."""
        if self.memo is None:
            self.memo = WordTable(self.words, 1)
        out = np.zeros((len(texts), 2))
        lists = [words_of(t) for t in texts]
        for k, at in enumerate(self.memo.batch(lists)):
            if len(at):
                r = self.memo.rows[at, 0]
                n = min(RUN, len(r))
                c = np.concatenate([[0.0], np.cumsum(r)])
                out[k] = r.mean(), (c[n:] - c[:-n]).max() / n
        return out


class Tables:
    """The ratios of a model that is too large to gather, as (h, ratio) tables."""

    def __init__(self, ws: Workspace, gram: DataFrame, context: DataFrame):
        self.ws, self.gram, self.context = ws, gram, context

    def words(self, words: DataFrame) -> DataFrame:
        """word -> word, r: the ratio of each different word."""

        def run(batches):
            import pyarrow as pa

            for b in batches:
                for piece in slices(b):
                    start, full, before = _places(piece.column("text").to_pylist())
                    at = np.arange(len(full))
                    row = np.searchsorted(start, at, side="right") - 1
                    nth = at - start[row]
                    keep = nth > 0
                    wid = piece.column("wid").to_numpy()[row[keep]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(wid), pa.array(full[keep]), pa.array(before[keep]), pa.array(nth[keep] <= 2)], names=["wid", "h", "c", "hot"])

        words = self.ws.save(words.distinct().withColumn("wid", F.monotonically_increasing_id()), "different-words")
        places = self.ws.save(words.select("wid", F.col("word").alias("text")).mapInArrow(run, "wid long, h long, c long, hot boolean"), "places")
        salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        ratios = (places.select("h", "c", "hot").distinct().join(self.gram, "h", "left")
                  .join(self.context.select(F.col("h").alias("c"), F.col("ratio").alias("back")), "c", "left")
                  .select("h", F.explode(salts).alias("salt"), F.coalesce("ratio", "back", F.lit(0.0)).cast("double").alias("r")))
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("wid"), F.lit(SALTS)).cast("int")).otherwise(0)
        total = places.select("wid", "h", salt.alias("salt")).join(ratios, ["h", "salt"]).groupBy("wid").agg(F.sum("r").alias("r"))
        return self.ws.save(words.join(total, "wid").select("word", "r"), "word-ratios")

    def features(self, docs: DataFrame) -> DataFrame:
        """docs with whole and run; equal texts are read once."""

        def run(batches):
            import pyarrow as pa

            for b in batches:
                for piece in slices(b):
                    for t, text in zip(piece.column("t").to_pylist(), texts_of(piece.column("text"))):
                        words = words_of(text)
                        for a in range(0, len(words), 100_000):
                            part = words[a:a + 100_000]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([t] * len(part), pa.binary()), pa.array(range(a, a + len(part)), pa.int64()), pa.array(part, pa.string())],
                                names=["t", "pos", "word"])

        docs = docs.withColumn("t", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
        texts = docs.select("t", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["t"])
        found = self.ws.save(texts.mapInArrow(run, "t binary, pos long, word string"), "occurrences")
        last = Window.partitionBy("t").orderBy("pos").rowsBetween(1 - RUN, 0)
        rows = found.join(self.words(found.select("word")), "word").select("t", "r", F.sum("r").over(last).alias("s"), F.count("*").over(last).alias("k"))
        mean = F.sum("r") / F.count("*")
        out = rows.groupBy("t").agg(mean.alias("whole"), F.coalesce(F.max(F.when(F.col("k") == RUN, F.col("s"))) / RUN, mean).alias("run"))
        return docs.join(out, "t", "left").fillna(0.0, ["whole", "run"])


def fit_model(ws: Workspace, rows: DataFrame) -> Model | Tables:
    """Model from (text, y) rows."""
    return _fit(ws, ws.save(_word_counts(rows), "words"))


def _fit(ws: Workspace, words: DataFrame) -> Model | Tables:
    grams = ws.save(_grams(words), "grams").withColumn("c", F.expr("substring(g, 1, length(g) - 1)"))
    ctx = ws.save(grams.groupBy("c").agg(*[f(F.col(f"c{y}"), y) for y in (0, 1) for f in (
        lambda c, y: F.sum(c).alias(f"n{y}"), lambda c, y: F.sum((c > 0).cast("long")).alias(f"t{y}"))]), "contexts")
    back = [F.when(F.col(f"n{y}") > 0, F.lit(DISCOUNT) * F.col(f"t{y}") / F.col(f"n{y}")).otherwise(1.0) for y in (0, 1)]
    own = [F.when(F.col(f"n{y}") > 0, F.greatest(F.col(f"c{y}") - DISCOUNT, F.lit(0.0)) / F.col(f"n{y}")).otherwise(0.0) for y in (0, 1)]
    ws.release()
    shared = _shared(ws, grams.select("g"))
    ws.release()
    p = F.coalesce("p", F.lit(1 / ALPHABET))
    ratio = F.log(own[1] + back[1] * p) - F.log(own[0] + back[0] * p)
    full = (grams.withColumn("t", F.expr("substring(g, 2)")).join(shared, "t", "left").join(ctx, "c")
            .select("g", ratio.alias("ratio")))
    contexts = ctx.select("c", (F.log(back[1]) - F.log(back[0])).alias("ratio"))
    gram, context = ws.save(_table(full, "g", False), "gram-ratios"), ws.save(_table(contexts, "c", True), "context-ratios")
    ws.release()
    if gram.count() + context.count() <= GATHER:
        return Model(_sorted(gram), _sorted(context))
    return Tables(ws, gram, context)


def _features(docs: DataFrame, model: Model | Tables, extra: str = "") -> DataFrame:
    """Adds whole and run to doc_id (and y)."""
    keep = ["doc_id", *(["y"] if extra else [])]
    if isinstance(model, Tables):
        return model.features(docs.select(*keep, "text")).select(*keep, "whole", "run")
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch):
                f = model.value.features(texts_of(piece.column("text")))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(f[:, 0]), pa.array(f[:, 1])], names=[*keep, "whole", "run"])

    return docs.select(*keep, "text").mapInArrow(run, f"doc_id long{extra}, whole double, run double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights and intercept (last) by Newton steps, on standardised columns."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.array([*(w[:-1] / sd), w[-1] - (w[:-1] * mean / sd).sum()])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    labels = ws.save(labels.withColumn("fold", fold(F.col("doc_id"), 5)).filter("fold <> 0"), "labels")
    n, toxic = labels.agg(F.count("*"), F.sum("y")).first()
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    if not n or not toxic or toxic == n:
        rate = float(toxic or 0) / max(n, 1)
        return docs.select("doc_id", held, F.lit(rate).alias("score"), F.lit(int(rate >= 0.5)).alias("predicted"))
    words, aside = (ws.save(_word_counts(labelled(docs, labels.filter(part).select("doc_id", "y")).select("text", "y")), "words") for part in ("fold > 1", "fold = 1"))
    rows = _features(labelled(docs, labels.filter("fold = 1").select("doc_id", "y")), _fit(ws, words), ", y int")
    sample = ws.save(rows, "calibration").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS).select("whole", "run", "y").toPandas()
    y = sample["y"].to_numpy(float)
    seen = words.agg(F.sum("c0"), F.sum("c1")).first()
    if 0 < y.sum() < len(y) and all(seen):
        a, b, c = (float(v) for v in logistic(sample[["whole", "run"]].to_numpy(), y))
    else:  # too few rows for a curve, or a first model of one class: even odds at one nat a word over the run
        a, b, c = 0.0, 2.0, -2.0
    ws.release()
    words = ws.save(words.unionByName(aside).groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "words")
    odds = F.lit(a) * F.col("whole") + F.lit(b) * F.col("run") + F.lit(c)
    out = _features(docs, _fit(ws, words)).select("doc_id", held, (1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(700.0)), F.lit(-700.0))))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
