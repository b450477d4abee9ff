"""Demonstration selection (the evaluation-time strategies) and few-shot prompts.

Semantics, per sample ``s`` (samples ordered by ``idx``):
scan the pool from the latest row backwards and take the first K *distinct*
tuples ``(input, label, category)`` whose input differs from ``s.input`` and
that pass the strategy's criterion; a sample with fewer than K is dropped.
``random`` accepts every candidate (so it is "latest K", not random),
``cluster-random`` requires an equal category (NULL equals NULL), and a list
category requires a shared element.

Bounded rewrite.  A sample excludes one input only, so its K demos lie among
the latest K tuples of the latest K+1 inputs of its category: at most K(K+1)
candidates per category, whatever the category size.  The candidate lists
are built with top-k windows (``WindowGroupLimit`` trims each map task before
the shuffle, so a hot category never gathers in one task) and then joined to
the samples on the category with ``keyed_join``.  The per-sample work is a
filter and slice over at most K(K+1) array elements: no sample-side shuffle.

With list categories nearly every element may be a key of its own, so there the
lists hold no texts: rows are cut to ids, fingerprints and word counts first
(``slim``), and only the chosen demos' texts are fetched, if the caller wants
them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demoforge.functions.text import word_count as _wc
from demoforge.operators.joins import keyed_join
from demoforge.session import cut_lineage

STRATEGIES = ("random", "cluster-random")

DEMO_FIELDS = ("idx", "input", "label", "nw", "fp")
SLIM_FIELDS = ("idx", "label", "nw", "fp")


def _category_key(strategy: str, by: Sequence[str] = ()) -> Column:
    """Non-null string key of the candidate pool a sample draws from: its
    task (``by`` columns) and, for ``cluster-random``, its category (NULL is
    its own group, as None == None)."""
    task = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in by]
    if strategy == "random":
        cat = F.lit("*")
    elif strategy == "cluster-random":
        cat = F.coalesce(F.concat(F.lit("v:"), F.col("category").cast("string")), F.lit("null"))
    else:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    return F.concat_ws("\u0001", *task, cat) if task else cat


def text_fingerprint(col: str | Column) -> Column:
    """128-bit digest of the text and its length (-1 for NULL).

    Tuples are grouped and ranked on this instead of on the text, so long
    inputs never travel through the grouping and ranking shuffles; two of n
    different texts of one length agree by chance with about n^2 / 2^129."""
    c = F.col(col) if isinstance(col, str) else col
    return F.struct(F.unhex(F.md5(F.coalesce(c, F.lit("")))).alias("h"), F.coalesce(F.length(c), F.lit(-1)).alias("n"))


def drop_same_input(cands: Column, value: Column) -> Column:
    """Candidates whose input (fingerprint ``fp``) differs from ``value``.

    Written without an outer column inside the lambda (the value is zipped
    in), so a predicate on the result stays above the join it needs."""
    n = F.size(cands)
    paired = F.zip_with(cands, F.array_repeat(value, n), lambda c, v: F.when(c["fp"] != v, c))
    return F.filter(paired, lambda c: c.isNotNull())


def slim(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples without their input: its fingerprint ``fp`` and word count
    ``nwi`` stand for it, which is all a selection reads.  Written once."""
    return cut_lineage(samples.select(*by, "idx", "label", "category", text_fingerprint("input").alias("fp"),
                                      _wc("input").alias("nwi")))


def _fp(df: DataFrame) -> Column:
    return F.col("fp") if "fp" in df.columns else text_fingerprint("input")


def distinct_tuples(pool: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct ``(by.., category, input fingerprint, label)`` tuples with
    their latest position and row count; shareable between strategies."""
    return pool.groupBy(*by, "category", _fp(pool).alias("fp"), "label").agg(
        F.max("idx").alias("idx"), F.count(F.lit(1)).alias("_n"))


#: candidates up to this number are broadcast to the scan that fetches their texts
BROADCAST_CANDIDATES = 200_000


def candidate_lists(pool: DataFrame, k: int, key: Column, single_key: bool = False,
                    tuples: DataFrame | None = None) -> DataFrame:
    """Per key: the <= K(K+1) candidate tuples, latest first.

    Returns ``(_ck, _cands ARRAY<STRUCT<idx, input, label, nw, fp>>, _w)``
    where ``idx`` is the tuple's latest position, ``nw`` the word count of
    its prompt line, ``fp`` its input fingerprint and ``_w`` the pool rows
    under the key (used to detect hot keys).  Only ids and fingerprints are
    shuffled.  The final candidates are written and counted, then broadcast
    (up to ``BROADCAST_CANDIDATES``) against the scan of the pool, so that the
    text column does not move; beyond that the join shuffles.  Candidates of a
    ``slim`` pool have no ``input``.
    """
    light = "fp" in pool.columns
    if tuples is None:
        tuples = cut_lineage(pool.groupBy(key.alias("_ck"), "category", _fp(pool).alias("fp"), "label").agg(
            F.max("idx").alias("idx"), F.count(F.lit(1)).alias("_n")
        ))
    else:
        # tuples per task are tuples per key too (the key refines the task);
        # for a coarser key (random) equal tuples of one task stay distinct
        # rows here only if their categories differ, as tuple identity says
        tuples = tuples.withColumn("_ck", key)
    weights = tuples.groupBy("_ck").agg(F.sum("_n").alias("_w"))
    by_input = Window.partitionBy("_ck", "fp").orderBy(F.col("idx").desc())
    top_tuples = tuples.withColumn("_r", F.row_number().over(by_input)).where(F.col("_r") <= k)
    latest = top_tuples.where(F.col("_r") == 1)
    if single_key:
        # one pool for everything: a top-(K+1) sort (each task keeps K+1
        # rows, the final merge sees tasks x (K+1)), not a global window
        top_inputs = latest.orderBy(F.col("idx").desc()).limit(k + 1).select("_ck", "fp")
    else:
        by_key = Window.partitionBy("_ck").orderBy(F.col("idx").desc())
        top_inputs = (
            latest.withColumn("_ri", F.row_number().over(by_key))
            .where(F.col("_ri") <= k + 1)
            .select("_ck", "fp")
        )
    cands = top_tuples.join(top_inputs, ["_ck", "fp"], "left_semi").select("_ck", "idx", "label", "fp")
    cands = cut_lineage(cands)
    small = cands.count() <= BROADCAST_CANDIDATES
    # row ids are unique inside a key (a task's samples): fetch by (key, idx)
    texts = pool.select(key.alias("_ck"), "idx", "nwi" if light else "input")
    cands = texts.join(F.broadcast(cands) if small else cands, ["_ck", "idx"]).withColumn(
        "nw", F.lit(2) + (F.col("nwi") if light else _wc("input")) + _wc("label"))
    lists = cands.groupBy("_ck").agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in (SLIM_FIELDS if light else DEMO_FIELDS)]))).alias("_cands")
    ).select("_ck", F.reverse("_cands").alias("_cands"))
    return lists.join(weights, "_ck")


def select_demos(
    samples: DataFrame,
    k: int = 3,
    strategy: str = "cluster-random",
    pool: DataFrame | None = None,
    out: str = "demos",
    drop_short: bool = True,
    by: Sequence[str] = (),
    tuples: DataFrame | None = None,
) -> DataFrame:
    """Add ``out`` = the K chosen demos (ARRAY<STRUCT<idx, input, label>>).

    ``pool`` is where demos come from (default: the samples themselves).
    ``by`` names task columns: demos come from the sample's own task.
    ``tuples`` may pass ``distinct_tuples(pool, by)`` computed once for
    several strategies over the same pool.  A ``slim`` pool (with ``slim``
    samples) gives demos without ``input``.
    Scalar categories only; list categories go through ``select_demos_overlap``.
    """
    pool = samples if pool is None else pool
    key = _category_key(strategy, by)
    held = ("fp", "nwi") if "fp" in pool.columns else ("input",)
    lists = candidate_lists(pool.select("idx", *held, "label", "category", *by), k, key,
                            single_key=(strategy == "random" and not by), tuples=tuples)
    joined = keyed_join(
        samples.withColumn("_ck", key), lists, "_ck", weight="_w", salt_by=F.col("idx"),
        how="inner" if drop_short else "left",
    )
    chosen = F.slice(drop_same_input(F.col("_cands"), _fp(samples)), 1, k)
    res = joined.withColumn(out, chosen).drop("_cands", "_ck")
    if drop_short:
        res = res.where(F.size(out) == k)
    return res


def select_demos_overlap(
    samples: DataFrame,
    k: int = 3,
    pool: DataFrame | None = None,
    out: str = "demos",
    by: Sequence[str] = (),
) -> DataFrame:
    """``cluster-random`` for ARRAY<STRING> categories: any shared element.
    ``by`` names task columns: demos come from the sample's own task.

    The K(K+1) bound holds per (task, element); a sample collects the lists of
    its elements, removes duplicates, re-ranks by recency and takes K.  An
    element may belong to one row only, so the lists hold ids and counts; the
    chosen demos' texts are fetched at the end, unless ``samples`` (and
    ``pool``) are ``slim``.
    """
    light = "fp" in samples.columns
    rows = samples if light else slim(samples, by)
    pool_rows = rows if pool is None or pool is samples else pool if light else slim(pool, by)
    task = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in by]
    key = F.concat_ws("\u0001", *task, F.col("_el")) if by else F.col("_el")
    element = F.explode(F.array_distinct("category")).alias("_el")
    el_pool = pool_rows.select(*by, "idx", "fp", "nwi", "label", "category", element)
    lists = candidate_lists(el_pool, k, key)
    exploded = rows.select(*by, "idx", "fp", element).withColumn("_ck", key)
    joined = keyed_join(exploded.drop("_el"), lists, "_ck", weight="_w", salt_by=F.col("idx"))
    per_el = joined.select(*by, "idx", drop_same_input(F.col("_cands"), F.col("fp")).alias("_c"))
    merged = per_el.groupBy(*by, "idx").agg(
        F.slice(F.reverse(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_c"))))), 1, k).alias(out)
    ).where(F.size(out) == k)
    if not light:
        merged = _with_texts(cut_lineage(merged), samples if pool is None else pool, out, by)
    return samples.join(merged, [*by, "idx"]).select(*samples.columns, out)


def _with_texts(chosen: DataFrame, pool: DataFrame, out: str, by: Sequence[str]) -> DataFrame:
    """Chosen demos (``by.., idx, out``) with their inputs, each text read by
    its task, id and fingerprint."""
    task = F.struct(*by) if by else F.lit(0)
    ex = chosen.select(*by, "idx", F.posexplode(out).alias("_p", "_d")).withColumn("_t", task)
    at = [F.col("_t"), F.col("_d.idx").alias("_i"), F.col("_d.fp").alias("_f")]
    wanted = ex.select(*at).distinct()
    texts = pool.select(task.alias("_t"), F.col("idx").alias("_i"), text_fingerprint("input").alias("_f"), "input") \
        .join(wanted, ["_t", "_i", "_f"], "left_semi").groupBy("_t", "_i", "_f").agg(F.first("input").alias("_input"))
    demo = F.struct(F.col("_d.idx").alias("idx"), F.col("_input").alias("input"),
                    *[F.col(f"_d.{c}").alias(c) for c in ("label", "nw", "fp")])
    full = ex.select(*by, "idx", "_p", "_d", *at).join(texts, ["_t", "_i", "_f"]).groupBy(*by, "idx").agg(
        F.sort_array(F.collect_list(F.struct("_p", demo.alias("_d")))).alias("_l"))
    return full.select(*by, "idx", F.transform("_l", lambda x: x["_d"]).alias(out))


def fewshot_prompt(demos: str | Column = "demos", input_col: str | Column = "input") -> Column:
    """``Input: x Prediction: y`` per demo in choice order, then the sample."""
    demos = F.col(demos) if isinstance(demos, str) else demos
    inp = F.col(input_col) if isinstance(input_col, str) else input_col
    lines = F.transform(
        demos,
        lambda d: F.concat(
            F.lit("Input: "), F.coalesce(d["input"], F.lit("None")),
            F.lit(" Prediction: "), F.coalesce(d["label"], F.lit("None")),
        ),
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\nInput: "), F.coalesce(inp, F.lit("None")), F.lit(" Prediction:"))


def word_count(col: str | Column) -> Column:
    """``len(text.split())``: runs of white space, ends trimmed."""
    return _wc(F.col(col) if isinstance(col, str) else col)


def prompt_word_count(demos: str = "demos", input_col: str = "input") -> Column:
    """Words of ``fewshot_prompt(demos, input)`` without building it: each
    demo line has ``Input:``, ``Prediction:`` and its two texts (``nw``),
    the sample line ``Input:``, ``Prediction:`` and the input."""
    return F.lit(2) + _wc(input_col) + _demo_words(demos)


def slim_prompt_word_count(demos: str = "demos") -> Column:
    """``prompt_word_count`` of ``slim`` samples."""
    return F.lit(2) + F.col("nwi") + _demo_words(demos)


def _demo_words(demos: str) -> Column:
    return F.aggregate(F.col(demos), F.lit(0), lambda a, d: a + d["nw"])


def demo_idx_string(demos: str = "demos") -> Column:
    """Chosen demos as their positions, in choice order, blank-separated."""
    return F.array_join(F.transform(F.col(demos), lambda d: d["idx"].cast("string")), " ")
