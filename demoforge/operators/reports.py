"""Result-log reports: group means, best prompts, box statistics, pivots.

Inputs are result rows ``(model, dataset, prompt, random_demos,
informative_demos[, difference])``; everything is grouped aggregation with
map-side partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoforge.operators.joins import keyed_join
from demoforge.operators.windows import running_sum
from demoforge.session import cut_lineage

ROUND = 6
SCORE_COLS = ("random_demos", "informative_demos", "difference")
KEY = ("model", "dataset", "prompt")


def with_difference(results: DataFrame) -> DataFrame:
    if "difference" in results.columns:
        return results
    return results.withColumn("difference", F.col("informative_demos") - F.col("random_demos"))


def mean_scores(results: DataFrame, by: Sequence[str] = KEY, digits: int | None = ROUND) -> DataFrame:
    """Group means, rounded for output (``digits=None``: not rounded)."""
    r = with_difference(results)
    return r.groupBy(*by).agg(*[(F.avg(c) if digits is None else F.round(F.avg(c), digits)).alias(c) for c in SCORE_COLS])


def best_prompt(results: DataFrame, score: str = "informative_demos") -> DataFrame:
    """Per (model, dataset) the prompt with the highest mean ``score``; the
    first prompt in key order on ties; NULL means are skipped.  Means are
    compared unrounded and rounded for output only."""
    means = mean_scores(results, digits=None).where(F.col(score).isNotNull())
    return means.groupBy("model", "dataset").agg(
        F.min_by("prompt", F.struct((-F.col(score)).alias("s"), F.col("prompt"))).alias("prompt"),
        F.round(F.max(score), ROUND).alias(score),
    )


def best_prompt_rows(results: DataFrame, best: DataFrame) -> DataFrame:
    """Rows whose (model, dataset, prompt) is a best prompt.  ``best`` has one
    row per (model, dataset): bounded by the number of runs, not by rows."""
    return results.join(best.select(*KEY), list(KEY), "left_semi")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def melt_strategies(results: DataFrame, ids: Sequence[str] = ("event_id", *KEY)) -> DataFrame:
    """Two score columns to (type, score) rows: ``random`` and ``info``."""
    r = results.select(*ids, F.col("random_demos").alias("random"), F.col("informative_demos").alias("info"))
    return r.unpivot(list(ids), ["random", "info"], "type", "score")


def rename_models(df: DataFrame, names: Sequence[tuple[str, str]], col: str = "model") -> DataFrame:
    """Map model ids to display names in the given order; unmapped rows drop.
    The mapping is a parameter list, broadcast by construction."""
    spark = df.sparkSession
    m = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(names)], f"{col} string, _new string, map_order int")
    return df.join(F.broadcast(m), col).withColumn(col, F.col("_new")).drop("_new")


def value_counts_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct non-NULL values per group with their counts (map-side
    combined: its size follows distinct values, not rows)."""
    v = df.select(*by, F.col(value).cast("double").alias("_val")).where(F.col("_val").isNotNull())
    return v.groupBy(*by, "_val").agg(F.count(F.lit(1)).alias("_c"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: dict[str, float],
                    counts: DataFrame | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, per group, without
    gathering a group in one task.

    Values are counted per (group, value), the counts are cumulated
    two-level (``running_sum``: buckets of the value range, so a hot group
    spreads over its buckets, and the bucket totals give the group size),
    and every distinct value reports the quantile ranks it covers.  Position
    of quantile q is q (n - 1); result = v[floor] + (pos - floor) (v[ceil] -
    v[floor]).  Returns ``(by.., n, <name>...)``."""
    by = list(by)
    vc = counts if counts is not None else value_counts_by(df, by, value)
    cum = running_sum(vc, "_c", by, ["_val"], out="_upto", total_out="n")
    hits = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("n") - 1)
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            covers = (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
            hits.append(F.when(covers, F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"),
                                                 F.col("_val").alias("v"), pos.alias("pos"))))
    found = cum.select(*by, "n", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    piv = found.groupBy(*by, "n").pivot("h.q", list(qs)).agg(
        F.max(F.when(F.col("h.side") == "lo", F.col("h.v"))).alias("lo"),
        F.max(F.when(F.col("h.side") == "hi", F.col("h.v"))).alias("hi"),
        F.max("h.pos").alias("pos"))
    cols = []
    for name in qs:
        lo, hi, pos = F.col(f"{name}_lo"), F.col(f"{name}_hi"), F.col(f"{name}_pos")
        cols.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    return piv.select(*by, "n", *cols)


def box_stats(df: DataFrame, by: Sequence[str], value: str = "score") -> DataFrame:
    """Quartiles (linear interpolation) and whiskers at 1.5 IQR clipped to
    the data, but never inside the box, per group.  Both work on the distinct values per group
    (written once): quantiles by ``exact_quantiles``, whiskers by joining the
    per-group fences (size-checked) and a min / max aggregate."""
    by = list(by)
    vc = cut_lineage(value_counts_by(df, by, value))
    q = exact_quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, counts=vc)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in by])
    stats = q.select(*by, "n", "q1", "median", "q3", key.alias("_g"), lo.alias("_lo"), hi.alias("_hi"),
                     F.col("n").alias("_w"))
    fenced = keyed_join(vc.withColumn("_g", key).drop(*by), stats, "_g", weight="_w",
                        salt_by=F.col("_val").cast("string"))
    out = fenced.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.least(F.col("q1"), F.min(F.when(F.col("_val") >= F.col("_lo"), F.col("_val")))).alias("whisker_lo"),
        F.greatest(F.col("q3"), F.max(F.when(F.col("_val") <= F.col("_hi"), F.col("_val")))).alias("whisker_hi"),
    )
    return out.select(*by, "n", *[F.round(c, ROUND).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")])


def wide_report(df: DataFrame, rows: Sequence[str], col: str, values: Sequence[str], value: str) -> DataFrame:
    """Rows = ``rows``, one column per listed value of ``col`` (mean of
    ``value``).  The column list is a parameter, as a pivot needs."""
    return df.groupBy(*rows).pivot(col, list(values)).agg(F.round(F.avg(value), ROUND))


def tail(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Last n rows in ``order`` (top-n of the reversed order)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def run_grid(tasks: DataFrame, **params: Sequence[str]) -> DataFrame:
    """Every task row with every combination of the parameter lists
    (models, strategies, ...): parameter lists expand by ``explode``."""
    out = tasks
    for name, values in params.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def skip_report(selected: DataFrame, k: int, max_words: int | None, words_col: str = "n_words",
                demos: str = "demos") -> DataFrame:
    """Counts of samples dropped for want of K demos or for prompt length."""
    short = F.coalesce(F.size(demos), F.lit(0)) < k
    long_ = (~short) & (F.col(words_col) > max_words) if max_words is not None else F.lit(False)
    return selected.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(F.when(short, 1)).alias("n_few_demos"),
        F.count(F.when(long_, 1)).alias("n_too_long"),
        F.count(F.when(~short & ~long_, 1)).alias("n_kept"),
    )

