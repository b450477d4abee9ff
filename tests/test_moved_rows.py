"""Steps that keep wide rows where they are: plans and results."""

import re

import pandas as pd
from pyspark.sql import functions as F

from demoforge.functions import text as T
from demoforge.operators import lookups as L
from demoforge.operators.predict import predict_prompts
from demoforge.session import cut_lineage


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_templates_read_their_rows_once(spark):
    d = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "c", None)], "id long, t string, l string")
    both = {"p": ("concat('P ', t)", "l"), "q": ("t", "coalesce(l, 'none')")}
    got = T.render_templates(d.join(d.select("id"), "id", "left_semi"), both, keep=["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "p", "P a", "x"), (1, "q", "a", "x"), (3, "q", "c", "none")]
    assert got.columns == ["id", "template", "input", "label"]
    assert plan(got).count("Join LeftSemi") == 1


def test_only_copied_prompts_are_grouped(spark, tmp_path, monkeypatch):
    grouped = []
    frame = type(spark.range(1))
    plain = frame.dropDuplicates
    monkeypatch.setattr(frame, "dropDuplicates", lambda self, *a: grouped.append(self.count()) or plain(self, *a))
    rows = [(i, f"prompt {i}") for i in range(50)] + [(i, "same") for i in range(50, 57)] + [(57, "prompt 3")]
    asked = spark.createDataFrame(rows, "k long, prompt string")
    for cache in (None, str(tmp_path / "cache"), str(tmp_path / "cache")):
        got = predict_prompts(asked, lambda p: p.str.upper(), "upper", cache)
        assert sorted((r.k, r.predicted) for r in got.collect()) == [(k, p.upper()) for k, p in rows]
    assert grouped == [9, 9, 9]


def test_written_table_with_a_split_a_core_is_not_shuffled(spark):
    cores = spark.sparkContext.defaultParallelism
    d = cut_lineage(spark.range(0, 4000, 1, 4 * cores).withColumn("t", F.repeat(F.lit("wide text "), 20)))
    spread = "Repartition" in plan(d)
    files = len(d.inputFiles())
    assert files >= cores and d.rdd.getNumPartitions() >= cores
    old, key = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.shuffle.partitions"
    spark.conf.set(key, str(16 * cores))
    try:
        again = cut_lineage(d)
        assert not spread and "Repartition" not in plan(again) and again.count() == 4000
    finally:
        spark.conf.set(key, old)


def test_cluster_facts_reads_a_clusters_ids_once(spark):
    q = spark.createDataFrame([(0, ["a", "b"]), (0, ["b", None, "z"]), (1, []), (2, None), (None, ["a"])], "cluster long, ids array<string>")
    dim = spark.createDataFrame([("a", " A "), ("b", "B"), ("c", "C")], "uid string, fact string")
    got = L.cluster_facts(q, "ids", dim, "uid", "fact")
    assert {r.cluster: (r.facts, r.n_missing) for r in got.collect()} == {0: (["A", "B"], 2), 1: ([], 0), 2: ([], 0), None: ([], 0)}
    assert not re.search(r"Join .*cluster", plan(got))
