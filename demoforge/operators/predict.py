"""Predictor contract: prompts in, predicted texts out.

A predictor is either a built-in column rule or a user function over a pandas
Series of prompts, run with ``mapInPandas`` so the model is loaded once per
task and fed batches of ``batch_size`` prompts (default: Arrow's batches).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from demoforge.operators.joins import join_ids
from demoforge.session import cut_lineage
from demoforge.sources import with_cache

MOCK_TEXT = "mock text"


def mock_prediction() -> Column:
    """Test mode of the remote model: every answer is ``mock text``."""
    return F.lit(MOCK_TEXT)


def demo_majority(demos: str | Column = "demos") -> Column:
    """Most frequent label among the demos; on ties the label of the latest demo."""
    d = F.col(demos) if isinstance(demos, str) else demos
    scored = F.transform(
        d,
        lambda x: F.struct(
            F.size(F.filter(d, lambda y: y["label"].eqNullSafe(x["label"]))).alias("n"),
            x["idx"].alias("at"),
            x["label"].alias("label"),
        ),
    )
    return F.array_max(scored)["label"]


BUILTIN = {"mock": lambda demos: mock_prediction(), "demo_majority": demo_majority}


def predict(
    df: DataFrame,
    predictor: str | Callable[[pd.Series], pd.Series],
    prompt_col: str = "prompt",
    demos_col: str = "demos",
    out: str = "predicted",
    batch_size: int | None = None,
) -> DataFrame:
    """Add ``out``; ``predictor`` is a built-in name or a batch function."""
    if isinstance(predictor, str):
        try:
            return df.withColumn(out, BUILTIN[predictor](demos_col))
        except KeyError:
            raise ValueError(f"unknown predictor {predictor}") from None
    fn = predictor
    schema = StructType(df.schema.fields + [StructField(out, StringType(), True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = batch_size or max(len(pdf), 1)
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at:at + step].copy()
                part[out] = pd.Series(fn(part[prompt_col])).astype(object).values
                yield part

    return df.mapInPandas(run, schema)


def predict_prompts(asked: DataFrame, fn: Callable[[pd.Series], pd.Series], model: str,
                    cache: str | None = None, batch_size: int | None = None) -> DataFrame:
    """``asked`` (with ``prompt``) plus ``predicted`` of a batch function.

    Every different prompt passes the function once: prompts are told apart by
    a 128-bit digest, only (digest, prompt) goes to Python, and the answers
    are written before they are joined back.  ``cache`` is a folder that keeps
    them by (model, digest); a prompt found there does not run again.

    Digests are counted first.  A prompt that is asked once goes to the
    function from where it is built; only copies are shuffled."""
    asked = asked.withColumn("prompt_id", F.md5("prompt"))
    each = asked.select(F.lit(model).alias("model"), "prompt_id", "prompt").where(F.col("prompt_id").isNotNull())
    asked = cut_lineage(asked.drop("prompt"))
    copied = cut_lineage(asked.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("prompt_id"))
    todo = join_ids(each, copied, "prompt_id", "left_anti").unionByName(
        join_ids(each, copied, "prompt_id", "left_semi").dropDuplicates(["prompt_id"])).select("model", "prompt_id", "prompt")

    def compute(missing: DataFrame) -> DataFrame:
        return predict(missing, fn, batch_size=batch_size).select("model", "prompt_id", "predicted")

    if cache is None:
        answers = cut_lineage(compute(todo))
    else:
        keys = asked.select(F.lit(model).alias("model"), "prompt_id")
        answers = with_cache(asked.sparkSession, todo, cache, ["model", "prompt_id"], compute, partition_by=["model"],
                             unique=True, keys=keys)
    return asked.join(answers.select("prompt_id", "predicted"), "prompt_id").drop("prompt_id")


def cut_at(col: str | Column, marker: str = "Input", model_col: str | Column | None = None,
           model: str | None = None) -> Column:
    """Keep what precedes ``marker``; only for ``model`` when one is given."""
    c = F.col(col) if isinstance(col, str) else col
    cut = F.split_part(c, F.lit(marker), F.lit(1))
    if model_col is None:
        return cut
    m = F.col(model_col) if isinstance(model_col, str) else model_col
    return F.when(m == F.lit(model), cut).otherwise(c)
