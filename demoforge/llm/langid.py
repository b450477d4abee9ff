"""Language identification by mixture inference over words.

Each language has likelihoods of character n-grams inside words (lengths 1 to
``ORDER``), from every training row.  A document is a mixture: each word comes
from one of its languages, with the product of its n-grams' likelihoods
(geometric mean over the lengths).  Expectation-maximisation estimates the
document's proportions.  Nested sets of its strongest languages are refitted and
compared by penalised likelihood (half a log of the number of words for each
further language); the prediction is the largest proportion of the best set.

The statistics grow with the corpus: every n-gram keeps its own counts, keyed by
a 64-bit hash of its letters and length.  The table is counted; up to ``GATHER``
cells (n-grams x languages) it is broadcast, a larger one stays a table: the
different words of each block of documents are scored by joins with it (words
once for the whole corpus, n-grams once for each word) and come back to their
block.  Both ways give the same scores.

Words without a letter say nothing and are left out.  ``und`` with score 0 is
returned for null texts and texts without a letter, and for all rows when there
is nothing to learn from; ties go to the language that sorts first.  Repeated
rows and empty tables need no special case.  Texts are read whole, whatever
their length; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoforge.llm.chars import WordTable, framed, gram_hashes, words_of
from demoforge.llm.common import Workspace
from demoforge.llm.encode import slices
from demoforge.llm.toxicity import fold

ORDER = 4
#: n-grams x languages that are broadcast
GATHER = 1 << 22
STEPS = 20
SMOOTHING = 0.1


def keys(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """For each place the key of the n-gram of ``length`` that ends there."""
    return (gram_hashes(data, start, length) * np.uint64(2 * length + 1) + np.uint64(length)).view(np.int64)


def _counts(rows: DataFrame) -> DataFrame:
    """(text, lang) -> lang, size, gram, n: how often each n-gram occurs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 4_000_000):
                words: dict[str, Counter] = {}
                for t, lang in zip(piece.column("text").to_pylist(), piece.column("lang").to_pylist()):
                    words.setdefault(lang, Counter()).update(words_of(t))
                for lang, count in words.items():
                    if not count:
                        continue
                    data, start = framed(list(count))
                    size = np.diff([*start, len(data)])
                    weight = np.repeat(np.fromiter(count.values(), dtype=np.int64), size)
                    for k in range(1, ORDER + 1):
                        gram, at = np.unique(keys(data, start, k), return_inverse=True)
                        n = np.bincount(at, weights=weight, minlength=len(gram)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), k, dtype=np.int32)), pa.array(gram), pa.array(n)],
                            names=["lang", "size", "gram", "n"])

    return rows.mapInArrow(run, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class Languages:
    """Names, log-likelihoods of unseen n-grams (a row for each length) and,
    where they are gathered, the keys of the seen ones with their
    log-likelihoods (a row each, ascending keys)."""

    def __init__(self, names: list[str], unseen: np.ndarray, grams=None, likelihood=None):
        self.names, self.unseen, self.grams, self.likelihood, self.memo = names, unseen, grams, likelihood, None

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    @classmethod
    def of(cls, ws: Workspace, counts: DataFrame) -> tuple[Languages, DataFrame]:
        """The model, and its n-grams as a table (gram, size, one
        log-likelihood above that of an unseen one for each language)."""
        # one row for each language and length
        sums = counts.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()
        seen = {r["size"]: r["n"] for r in counts.select("size", "gram").distinct().groupBy("size").agg(F.count("*").alias("n")).collect()}
        names = sorted({r["lang"] for r in sums})
        row = {x: i for i, x in enumerate(names)}
        room = np.full((ORDER, len(names)), SMOOTHING) * np.array([[max(seen.get(k, 0), 1)] for k in range(1, ORDER + 1)])
        for r in sums:
            room[r["size"] - 1, row[r["lang"]]] += r["n"]
        unseen = np.log(SMOOTHING) - np.log(room)
        above = F.log((F.coalesce("n", F.lit(0)) + SMOOTHING) / SMOOTHING)
        table = counts.groupBy("gram", "size").agg(*[
            F.sum(F.when(F.col("lang") == x, above)).alias(f"l{i}") for i, x in enumerate(names)]).fillna(0.0)
        table = ws.save(table, "grams")
        if sum(seen.values()) * len(names) > GATHER:
            return cls(names, unseen), table
        held = table.toPandas().sort_values("gram", kind="stable")
        known = held[[f"l{i}" for i in range(len(names))]].to_numpy() + unseen[held["size"].to_numpy() - 1]
        return cls(names, unseen, held["gram"].to_numpy(), known), table

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language; NaN without a letter."""
        data, start = framed(words)
        total = np.zeros((len(data), len(self.names)))
        for k in range(1, ORDER + 1):
            gram = keys(data, start, k)
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            total += np.where((self.grams[at] == gram)[:, None], self.likelihood[at], self.unseen[k - 1])
        return self.finished(words, np.add.reduceat(total, start, axis=0))

    @staticmethod
    def finished(words: list[str], total: np.ndarray) -> np.ndarray:
        out = total / ORDER
        out -= out.max(axis=1, keepdims=True)
        out[[not any(map(str.isalpha, w)) for w in words]] = np.nan
        return out

    @staticmethod
    def mixture(p: np.ndarray, m: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood of words with likelihoods p (words x
        languages) and multiplicities m."""
        share = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(steps if p.shape[1] > 1 else 0):
            mix = p * share
            total = mix.sum(axis=1)
            new = (m / total) @ mix / m.sum()
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(m @ np.log(np.maximum(p @ share, 1e-300)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if self.memo is None:
            self.memo = WordTable(self.words, len(self.names))
        lists = self.memo.batch([words_of(t or "") for t in texts])
        return self.decide(lists, self.memo.rows)

    def decide(self, lists: list[np.ndarray], scores: np.ndarray) -> list[tuple[str, float]]:
        """Language and proportion of documents given as rows of word scores."""
        out = []
        for at in lists:
            at, m = np.unique(at, return_counts=True)
            rows = scores[at] if len(at) else np.zeros((0, 1))
            keep = ~np.isnan(rows[:, 0])
            if not keep.any():
                out.append(("und", 0.0))
                continue
            p, m = np.exp(np.maximum(rows[keep], -300)), m[keep].astype(float)
            share, _ = self.mixture(p, m)
            order = np.argsort(-share, kind="stable")
            best = None
            for k in range(1, len(order) + 1):
                part, fit = self.mixture(p[:, order[:k]], m)
                value = fit - 0.5 * (k - 1) * np.log(max(m.sum(), 2))
                if best is not None and value <= best[0]:
                    break
                best = (value, part, order[:k])
            top = int(best[1].argmax())
            out.append((self.names[best[2][top]], float(min(max(best[1][top], 0), 1))))
        return out


def _by_blocks(ws: Workspace, base: DataFrame, model: Languages, table: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score with a model that stays a table.

    A block is a piece of a task's documents; it sends each of its different
    words once, however often they occur in it."""
    names, unseen = model.names, model.unseen
    cols = [f"l{i}" for i in range(len(names))]

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column("text").to_pylist()
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), piece.column("doc_id"), pa.array(texts, pa.string()), pa.nulls(n, pa.string())],
                    names=["block", "doc_id", "text", "word"])
                words = sorted({w for t in texts for w in words_of(t or "")})
                n = len(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(words, pa.string())],
                    names=["block", "doc_id", "text", "word"])
                block += 1

    rows = ws.save(base.select("doc_id", "text").mapInArrow(cut, "block long, doc_id long, text string, word string"), "blocks")

    def grams(batches):
        """word -> its n-grams, each with its number in the word."""
        import pyarrow as pa

        for batch in batches:
            words = batch.column("word").to_pylist()
            for a in range(0, len(words), 20_000):
                own = words[a:a + 20_000]
                data, start = framed(own)
                word = np.repeat(np.arange(len(own)), np.diff([*start, len(data)]))
                for k in range(1, ORDER + 1):
                    both, n = np.unique(np.stack([word, keys(data, start, k)]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([own[i] for i in both[0]], pa.string()), pa.array(np.full(both.shape[1], k, dtype=np.int32)),
                         pa.array(both[1]), pa.array(n)], names=["word", "size", "gram", "times"])

    words = rows.filter("word IS NOT NULL").select("word").distinct()
    parts = words.mapInArrow(grams, "word string, size int, gram long, times long")
    # the first of the lengths is as long as the word with its frame
    length = F.max(F.when(F.col("size") == 1, F.col("places")))
    known = ws.save(parts, "word-grams")
    places = known.groupBy("word", "size").agg(F.sum("times").alias("places")).groupBy("word").agg(length.alias("places"))
    hits = known.join(table, ["size", "gram"]).groupBy("word").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in cols])
    scores = ws.save(places.join(hits, "word", "left").fillna(0.0, cols), "word-scores")
    mine = rows.filter("word IS NOT NULL").select(F.col("block").alias("of"), "word").join(scores, "word")

    def judged(key, documents, words):
        import pandas as pd

        total = words[cols].to_numpy(dtype=float) + words[["places"]].to_numpy(dtype=float) * unseen.sum(axis=0)
        names_ = words["word"].tolist()
        rows = Languages.finished(names_, total) if len(words) else np.zeros((0, len(names)))
        at = {w: i for i, w in enumerate(names_)}
        lists = [np.array([at[w] for w in words_of(t if isinstance(t, str) else "")], dtype=np.int64) for t in documents["text"]]
        found = Languages(names, unseen).decide(lists, rows)
        return pd.DataFrame({"doc_id": documents["doc_id"], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    docs = rows.filter("word IS NULL").select("block", "doc_id", "text")
    return docs.groupBy("block").cogroup(mine.groupBy("of")).applyInPandas(judged, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows with a language
    whose crc32(doc_id as text) mod 4 is not 2."""
    spark = docs.sparkSession
    ws = Workspace(spark, "langid")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = fold(F.col("doc_id"), 4) == 2
    counts = ws.save(_counts(base.filter(~held).filter("lang is not null and text is not null").select("text", "lang")), "counts")
    if counts.isEmpty():
        return base.select("doc_id", held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model, table = Languages.of(ws, counts)
    if model.grams is None:
        found = _by_blocks(ws, base, model, table)
        return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
    model = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch):
                found = model.value.predict(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                    names=["doc_id", "lang_pred", "score"])

    return base.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held.alias("held_out"), "lang_pred", "score")
