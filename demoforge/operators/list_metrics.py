"""Metrics over lists of (expected, predicted) texts, not means of row scores.

Three forms, from the most to the least scalable:

* ``CountMetric``: columns that are counted per row and pooled by a sum, and a
  formula over the pooled counts (micro F, pooled error rates).  Sums combine
  before the shuffle, and a bootstrap weighs them by how often a row was drawn.
* ``FoldMetric``: a Python state that takes up lists of rows and merges with
  other states (rank statistics on sketches, corpus n-gram counts).  Each task
  folds its rows batch by batch, only states are shuffled.
* any function of (expected list, predicted list): needs its whole list at
  once, so it runs on bootstrap rounds, whose size is a parameter, and on whole
  tasks of at most ``GROUP_ROWS`` rows (counted before anything is gathered).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoforge.functions.draws import draw
from demoforge.functions.text import py_words
from demoforge.operators.windows import dense_index
from demoforge.session import cut_lineage

#: the largest whole task that a plain function may be given
GROUP_ROWS = 100_000


@dataclass(frozen=True)
class CountMetric:
    """``counts(expected, predicted)``: named columns per row; ``finish`` maps
    the same names, summed over the rows, to the score (NULL where undefined)."""

    name: str
    counts: Callable[[Column, Column], dict[str, Column]]
    finish: Callable[[dict[str, Column]], Column]

    def names(self) -> list[str]:
        return list(self.counts(F.lit(""), F.lit("")))


@dataclass(frozen=True)
class FoldMetric:
    """``add(state, expected, predicted)`` and ``merge(a, b)`` return states;
    both must not depend on the order of rows."""

    name: str
    start: Callable[[], object]
    add: Callable[[object, list, list], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], float | None]

    def of(self, expected: list, predicted: list):
        return self.finish(self.add(self.start(), expected, predicted))


def micro_f1(name: str = "micro_f1") -> CountMetric:
    """F-score of pooled token counts: predicted words among the row's expected
    words, predicted words beside them, expected words never predicted.  A null text has no words."""

    def counts(expected: Column, predicted: Column) -> dict[str, Column]:
        e, p = (py_words(F.lower(F.coalesce(x, F.lit("")))) for x in (expected, predicted))
        e = F.array_distinct(e)
        hit = F.size(F.filter(p, lambda w: F.array_contains(e, w)))
        missed = F.size(F.filter(e, lambda w: ~F.array_contains(p, w)))
        return {"tp": hit, "fp": F.size(p) - hit, "fn": missed}

    def finish(c: dict[str, Column]) -> Column:
        denom = c["tp"] + F.lit(0.5) * (c["fp"] + c["fn"])
        return F.when(denom > 0, c["tp"] / denom)

    return CountMetric(name, counts, finish)


def is_list_metric(metric) -> bool:
    return isinstance(metric, (CountMetric, FoldMetric, ListFunction))


@dataclass(frozen=True)
class ListFunction:
    """A plain function of (expected list, predicted list) as a list metric."""

    function: Callable[[list, list], float | None]

    @property
    def name(self) -> str:
        return self.function.__name__

    def of(self, expected: list, predicted: list):
        return self.function(expected, predicted)


def _counted(df: DataFrame, metric: CountMetric, expected: str, predicted: str) -> DataFrame:
    """``df`` plus the counts of its rows, staged so that they are worked out once."""
    cols = metric.counts(F.col(expected), F.col(predicted))
    for n, c in cols.items():
        df = df.withColumn(f"_n_{n}", c.cast("double"))
    return df


def _pooled(metric: CountMetric, weight: Column) -> list[Column]:
    return [F.sum(F.col(f"_n_{n}") * weight).alias(f"_n_{n}") for n in metric.names()]


def _finished(metric: CountMetric) -> Column:
    return metric.finish({n: F.col(f"_n_{n}") for n in metric.names()})


def _value(x) -> float | None:
    return None if x is None or x != x else float(x)


def _lists(rows: DataFrame, by: Sequence[str], order: str, metric, expected: str, predicted: str, out: str) -> DataFrame:
    """Groups that are bounded by the caller, each as two lists in ``order``."""
    fields = {f.name: f for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in by)
    keys = list(by)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order, kind="stable")
        got = metric.of([None if x is None else x for x in pdf[expected]], [None if x is None else x for x in pdf[predicted]])
        return pd.DataFrame({**{c: pdf[c].iloc[:1].values for c in keys}, out: pd.Series([_value(got)], dtype="float64")})

    return rows.groupBy(*keys).applyInPandas(run, f"{schema}, {out} double")


def _folded(rows: DataFrame, by: Sequence[str], metric: FoldMetric, expected: str, predicted: str, out: str) -> DataFrame:
    """One state a task and group, then one merge a group."""
    keys = list(by)
    grouped = rows.select(F.to_json(F.struct(*keys)).alias("_key"), *keys, F.col(expected).alias("_e"), F.col(predicted).alias("_p"))

    def states(batches):
        import pyarrow as pa

        held: dict[str, object] = {}
        for b in batches:
            lists: dict[str, tuple[list, list]] = {}
            for k, e, p in zip(*(b.column(c).to_pylist() for c in ("_key", "_e", "_p"))):
                both = lists.setdefault(k, ([], []))
                both[0].append(e)
                both[1].append(p)
            for k, (e, p) in lists.items():
                held[k] = metric.add(held[k] if k in held else metric.start(), e, p)
        yield pa.RecordBatch.from_pydict(
            {"_key": list(held), "_state": [pickle.dumps(s) for s in held.values()]},
            schema=pa.schema([("_key", pa.string()), ("_state", pa.binary())]))

    def merged(pdf):
        import pandas as pd

        state = reduce(metric.merge, [pickle.loads(s) for s in pdf["_state"]])
        return pd.DataFrame({"_key": pdf["_key"].iloc[:1].values, out: pd.Series([_value(metric.finish(state))], dtype="float64")})

    # one row a task and group
    scores = grouped.select("_key", "_e", "_p").mapInArrow(states, "_key string, _state binary") \
        .groupBy("_key").applyInPandas(merged, f"_key string, {out} double")
    names = grouped.groupBy("_key").agg(*[F.first(c).alias(c) for c in keys])
    return names.join(scores, "_key").drop("_key")


def list_score(df: DataFrame, metric, by: Sequence[str] = (), expected: str = "expected", predicted: str = "predicted",
               order_col: str = "idx", out: str = "score") -> DataFrame:
    """``(by.., n, out)``: the metric over all rows of every group."""
    by = list(by)
    if isinstance(metric, CountMetric):
        g = _counted(df, metric, expected, predicted).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *_pooled(metric, F.lit(1)))
        return g.select(*by, "n", _finished(metric).alias(out))
    keyed = df if by else df.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if isinstance(metric, FoldMetric):
        scores = _folded(keyed, keys, metric, expected, predicted, out)
    else:
        sizes = cut_lineage(sizes)
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most > GROUP_ROWS:
            raise ValueError(f"{metric.name} needs its whole list, and a task has {most} rows; use a CountMetric or FoldMetric")
        scores = _lists(keyed.select(*keys, order_col, expected, predicted), keys, order_col, metric, expected, predicted, out)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return sizes.alias("a").join(scores.alias("b"), reduce(Column.__and__, same)).select(*[F.col(f"a.{k}") for k in by], "n", out)


def list_bootstrap(df: DataFrame, metric, rounds: int = 200, size: int = 100, by: Sequence[str] = (), seed: str | int = 0,
                   stream: str = "", expected: str = "expected", predicted: str = "predicted", order_col: str = "idx",
                   out: str = "score") -> DataFrame:
    """``(by.., round_id, out)``: the metric over ``size`` rows drawn with
    replacement, ``rounds`` times for every group.

    Draw j of round r takes position ``draw(seed, group/stream, r, j)`` of the
    group; a round has exactly ``size`` rows, whatever the group holds."""
    by = list(by)
    rows = df.select(*by, order_col, expected, predicted)
    if isinstance(metric, CountMetric):
        rows = _counted(rows, metric, expected, predicted).drop(expected, predicted)
    pos = cut_lineage(dense_index(rows, order_col, by=by, out="_pos", size_out="_rows"))
    label = F.concat_ws("/", *[F.col(c).cast("string") for c in by], F.lit(stream)) if by else F.lit(stream)
    picks = pos.where("_pos = 0").select(*by, "_rows").withColumn(
        "_rj", F.explode(F.sequence(F.lit(0), F.lit(rounds * size - 1)))).select(
        *by, "_rows", F.floor(F.col("_rj") / size).alias("round_id"), F.pmod(F.col("_rj"), F.lit(size)).alias("_j"))
    picks = picks.withColumn("_at", draw(F.lit(str(seed)), label, F.col("round_id"), F.col("_j"), n=F.col("_rows"))).drop("_rows")
    on = reduce(Column.__and__, [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in by], F.col("r._pos") == F.col("p._at"))
    keys = [*[F.col(f"r.{c}").alias(c) for c in by], "round_id"]
    if isinstance(metric, CountMetric):
        # how often a round drew a row, then one weighted row each
        times = picks.groupBy(*by, "round_id", "_at").agg(F.count(F.lit(1)).alias("_times"))
        drawn = pos.alias("r").join(times.alias("p"), on).select(*keys, "_times", *[f"_n_{n}" for n in metric.names()])
        return drawn.groupBy(*by, "round_id").agg(*_pooled(metric, F.col("_times"))).select(*by, "round_id", _finished(metric).alias(out))
    drawn = pos.alias("r").join(picks.alias("p"), on).select(*keys, "_j", expected, predicted)
    return _lists(drawn, [*by, "round_id"], "_j", metric, expected, predicted, out)
