"""Scoring, strategy comparison and bootstrap.

All metrics are means of a per-row score, so every report is a grouped
``avg``: partial aggregation runs map-side and only one row per group and
task crosses the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoforge.functions.draws import draw
from demoforge.functions.scores import with_score
from demoforge.operators.list_metrics import is_list_metric, list_bootstrap, list_score
from demoforge.operators.demos import (distinct_tuples, fewshot_prompt, prompt_word_count, select_demos, select_demos_overlap,
                                       slim, slim_prompt_word_count)
from demoforge.operators.predict import predict, predict_prompts
from demoforge.session import cut_lineage
from demoforge.operators.windows import dense_index

ROUND = 6


def r6(c) -> "Column":
    """Round to 6 decimals, with a signed zero printed as 0.0."""
    x = F.round(F.col(c) if isinstance(c, str) else c, ROUND)
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def score(df: DataFrame, metric: str, expected: str = "label", predicted: str = "predicted",
          out: str = "score") -> DataFrame:
    return with_score(df, metric, expected, predicted, out)


def mean_score(df: DataFrame, metric: str, by: Sequence[str] = (), expected: str = "expected",
               predicted: str = "predicted") -> DataFrame:
    """Metric per group: ``n`` rows and the rounded mean (NULL when n = 0)."""
    scored = with_score(df, metric, expected, predicted, "_s")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("_s")).alias("score"),
    )


def strategy_gap(
    samples: DataFrame,
    k: int = 3,
    predictor: str | Sequence = "demo_majority",
    metric: str = "accuracy_exact",
    max_words: int | None = None,
    by: Sequence[str] = (),
    model_name: str | None = None,
    bootstrap_rounds: int = 0,
    bootstrap_size: int = 100,
    seed: int | str = 0,
    first_n: int | None = None,
    cache: str | None = None,
    batch_size: int | None = None,
    informative: str = "cluster-random",
) -> DataFrame:
    """Random against informative (same category) demos on one sample set.

    The informative run selects demos by category and drops prompts longer
    than ``max_words``; the random run reuses its surviving samples without
    the word limit.  Both runs are columns of the same rows, so they are
    aligned without a join.  ``predictor`` may list several predictors (a
    run grid): demos are chosen once and each predictor adds its rows.

    A predictor is a built-in name or a function over a pandas Series of
    prompts, run in batches of ``batch_size`` once for every different prompt
    (``cache``: a folder that keeps its answers).  The scores are written
    before they are averaged or bootstrapped, so a bootstrap repeats no
    prediction.  ``metric`` is a name, a function of two columns, or a metric
    over lists (``list_metrics``), taken over all rows of a task or over the
    rows of a bootstrap round.  ``informative`` is ``cluster-random`` or, for
    list categories, ``overlap`` (any shared element).
    """
    predictors = predictor if isinstance(predictor, (list, tuple)) else [predictor]
    # built-in predictors read labels and ids: the texts are left behind at once
    light = all(isinstance(p, str) for p in predictors)
    if light:
        samples = slim(samples, by)
    evaluated = samples if first_n is None else samples.orderBy(*by, "idx").limit(first_n) if not by else \
        _first_per_task(samples, by, first_n)
    # both strategies rank the same distinct tuples of the pool: build them once
    tuples = cut_lineage(distinct_tuples(samples, by))
    if informative == "overlap":
        info = select_demos_overlap(evaluated, k, pool=samples, out="demos_info", by=by)
    else:
        info = select_demos(evaluated, k, informative, pool=samples, out="demos_info", by=by, tuples=tuples)
    if max_words is not None:
        words = slim_prompt_word_count("demos_info") if light else prompt_word_count("demos_info")
        info = info.where(words <= max_words)
    both = select_demos(info, k, "random", pool=samples, out="demos_rand", by=by, tuples=tuples)
    names = [model_name or (p if isinstance(p, str) else getattr(p, "__name__", "custom")) for p in predictors]
    if len(set(names)) < len(names):
        raise ValueError(f"predictors need different names, not {names}")
    if not light:
        both = cut_lineage(both.select(*by, "idx", "input", "label", "demos_info", "demos_rand"))
    scored = both
    # built-in predictors add columns to the same rows: one pass over the selection
    for i, p in enumerate(predictors):
        if isinstance(p, str):
            scored = predict(scored, p, demos_col="demos_info", out=f"_pi{i}")
            scored = predict(scored, p, demos_col="demos_rand", out=f"_pr{i}")
    keys = [*by, "idx"]
    for i, p in enumerate(predictors):
        if isinstance(p, str):
            continue
        def prompt(demos, *columns):
            return F.struct(F.array(*[F.lit(c) for c in columns]).alias("strategies"), fewshot_prompt(demos).alias("prompt"))

        # equal demonstrations of both strategies make one prompt
        info_col, rand_col = f"_pi{i}", f"_pr{i}"
        asked = both.select(*keys, F.explode(
            F.when(F.col("demos_info").eqNullSafe(F.col("demos_rand")), F.array(prompt("demos_info", info_col, rand_col)))
            .otherwise(F.array(prompt("demos_info", info_col), prompt("demos_rand", rand_col)))).alias("_a")).select(*keys, "_a.*")
        got = predict_prompts(asked, p, names[i], cache, batch_size).withColumn("strategy", F.explode("strategies"))
        wide = got.groupBy(F.struct(*keys).alias("_k")).pivot("strategy", [f"_pi{i}", f"_pr{i}"]).agg(F.max("predicted"))
        scored = scored.withColumn("_k", F.struct(*keys)).join(wide, "_k").drop("_k")
    if is_list_metric(metric):
        texts = cut_lineage(scored.select(*keys, "label", *[f"{c}{i}" for i in range(len(names)) for c in ("_pi", "_pr")]))
        parts = [_list_gap(texts, metric, i, name, by, bootstrap_rounds, bootstrap_size, seed) for i, name in enumerate(names)]
        return reduce(DataFrame.unionByName, parts)
    for i in range(len(predictors)):
        scored = with_score(scored, metric, "label", f"_pi{i}", f"_si{i}")
        scored = with_score(scored, metric, "label", f"_pr{i}", f"_sr{i}")
    both = cut_lineage(scored.select(*keys, *[f"{c}{i}" for i in range(len(names)) for c in ("_si", "_sr")]))
    if bootstrap_rounds:
        outs = [_bootstrap_gap(both.select(*by, "idx", F.col(f"_sr{i}").alias("s_rand"),
                                           F.col(f"_si{i}").alias("s_info")),
                               by, bootstrap_rounds, bootstrap_size, seed, name)
                for i, name in enumerate(names)]
        res = outs[0]
        for o in outs[1:]:
            res = res.unionByName(o)
        return res
    agg = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        *[F.avg(f"_sr{i}").alias(f"_r{i}") for i in range(len(names))],
        *[F.avg(f"_si{i}").alias(f"_i{i}") for i in range(len(names))],
    )
    per_model = F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"_r{i}").alias("r"), F.col(f"_i{i}").alias("i"))
        for i, name in enumerate(names)]))
    rows = agg.select(*by, "n_samples", per_model.alias("_m"))
    return rows.select(
        *by,
        F.col("_m.model").alias("model"),
        "n_samples",
        r6("_m.r").alias("random_demos"),
        r6("_m.i").alias("informative_demos"),
        r6(F.col("_m.i") - F.col("_m.r")).alias("difference"),
    )


def _list_gap(texts: DataFrame, metric, i: int, name: str, by: Sequence[str], rounds: int, size: int, seed) -> DataFrame:
    """Random and informative predictions of model ``i`` under a list metric."""
    by = list(by)
    parts = []
    for col, stream, out in ((f"_pr{i}", "random", "r"), (f"_pi{i}", "informative", "i")):
        if rounds:
            parts.append(list_bootstrap(texts, metric, rounds, size, by, seed, stream, "label", col, out=out))
        else:
            parts.append(list_score(texts, metric, by, "label", col, out=out))
    keys = [*by, "round_id" if rounds else "n"]
    a, b = (p.withColumn("_k", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})) for p in parts)
    both = a.join(b.select("_k", "i"), "_k")
    shown = F.col("round_id") if rounds else F.col("n").alias("n_samples")
    return both.select(*by, F.lit(name).alias("model"), shown, r6("r").alias("random_demos"), r6("i").alias("informative_demos"),
                       r6(F.col("i") - F.col("r")).alias("difference"))


def strategy_score(
    samples: DataFrame,
    k: int = 3,
    strategy: str = "cluster-random",
    predictor="demo_majority",
    metric: str = "rouge_l",
    max_words: int | None = None,
    first_n: int | None = None,
    by: Sequence[str] = (),
    model_name: str | None = None,
    cache: str | None = None,
    batch_size: int | None = None,
) -> DataFrame:
    """One strategy alone, with its own word limit and number of samples:
    ``(by.., model, strategy, n_samples, score)``."""
    light = isinstance(predictor, str)
    if light:
        samples = slim(samples, by)
    evaluated = samples if first_n is None else samples.orderBy("idx").limit(first_n) if not by else \
        _first_per_task(samples, by, first_n)
    sel = select_demos(evaluated, k, strategy, pool=samples, by=by)
    if max_words is not None:
        sel = sel.where((slim_prompt_word_count("demos") if light else prompt_word_count("demos")) <= max_words)
    name = model_name or (predictor if isinstance(predictor, str) else getattr(predictor, "__name__", "custom"))
    if isinstance(predictor, str):
        out = predict(sel, predictor)
    else:
        asked = sel.select(*by, "idx", "label", fewshot_prompt("demos").alias("prompt"))
        out = predict_prompts(asked, predictor, name, cache, batch_size)
    scored = with_score(out, metric, "label", "predicted", "_s")
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), r6(F.avg("_s")).alias("score")).select(
        *by, F.lit(name).alias("model"), F.lit(strategy).alias("strategy"), "n_samples", "score")


def bootstrap(
    scored: DataFrame,
    score_col: str = "score",
    rounds: int = 200,
    size: int = 100,
    seed: str | int = 0,
    stream: str | Column = "",
    order_col: str = "idx",
) -> DataFrame:
    """Mean score over ``rounds`` draws of ``size`` rows with replacement.

    Rows get a dense position 0..n-1 (by ``order_col``); draw j of round r
    picks position ``draw(seed, stream, r, j) mod n``.  The pick table has
    rounds x size rows (parameters, not data) and is broadcast against the
    scored rows, which are never shuffled.
    """
    spark = scored.sparkSession
    pos = cut_lineage(dense_index(scored.select(order_col, score_col), order_col, out="_pos"))
    n = pos.count()
    if not n:
        return spark.createDataFrame([], "round_id BIGINT, score DOUBLE")
    picks = (
        spark.range(rounds * size)
        .select(F.floor(F.col("id") / size).alias("round_id"), F.pmod(F.col("id"), F.lit(size)).alias("j"))
        .withColumn("_pos", draw(F.lit(str(seed)), stream, F.col("round_id"), F.col("j"), n=n))
    )
    counts = picks.groupBy("round_id", "_pos").agg(F.count(F.lit(1)).alias("_c"))
    joined = pos.join(F.broadcast(counts), "_pos")
    return joined.groupBy("round_id").agg(
        F.round(F.sum(F.col(score_col) * F.col("_c")) / F.lit(size), ROUND).alias("score")
    )


def _first_per_task(samples: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """First ``n`` samples of every task (top-n window: partial limits run
    before the shuffle)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy("idx")
    return samples.withColumn("_fn", F.row_number().over(w)).where(F.col("_fn") <= n).drop("_fn")


def _bootstrap_gap(scored: DataFrame, by: Sequence[str], rounds: int, size: int, seed, model: str) -> DataFrame:
    """Per task and round: mean of ``size`` draws with replacement, random
    and informative each from its own draw stream, then the difference."""
    by = list(by)
    pos = dense_index(scored, "idx", by=by, out="_pos", size_out="_n")
    sizes = pos.select(*by, "_n").distinct()
    picks = sizes.withColumn(
        "_rj", F.explode(F.sequence(F.lit(0), F.lit(rounds * size - 1)))).select(
        *by, "_n", F.floor(F.col("_rj") / size).alias("round_id"), F.pmod(F.col("_rj"), F.lit(size)).alias("j"))
    parts = []
    for stream, col in (("random", "s_rand"), ("informative", "s_info")):
        p = picks.withColumn("_pos", draw(F.lit(str(seed)), F.concat_ws("/", *[F.col(c).cast("string") for c in by],
                                                                        F.lit(stream)),
                                          F.col("round_id"), F.col("j"), n=F.col("_n")))
        c = p.groupBy(*by, "round_id", "_pos").agg(F.count(F.lit(1)).alias("_c"))
        m = pos.select(*by, "_pos", col).join(c, [*by, "_pos"]).groupBy(*by, "round_id").agg(
            (F.sum(F.col(col) * F.col("_c")) / F.lit(size)).alias(col))
        parts.append(m)
    g = parts[0].join(parts[1], [*by, "round_id"])
    return g.select(*by, F.lit(model).alias("model"), "round_id",
                    r6("s_rand").alias("random_demos"), r6("s_info").alias("informative_demos"),
                    r6(F.col("s_info") - F.col("s_rand")).alias("difference"))
