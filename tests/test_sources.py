"""Sources and sinks on files in a fresh temp folder (local tests only)."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from demoforge import sources as S


def _tmp():
    return tempfile.mkdtemp(prefix="demoforge-test-")


def test_task_dir_scan(spark):
    d = _tmp()
    for name, inst in (("task001_a", [("i1", ["o1", "o2"]), ("i2", ["o3"])]), ("task002_b", [("j1", ["p1"])])):
        with open(os.path.join(d, name + ".json"), "w") as f:
            json.dump({"Definition": ["x"], "Instances": [{"input": i, "output": o} for i, o in inst]}, f)
    rows = sorted(tuple(r) for r in S.read_task_dir(spark, d).collect())
    assert rows == [("task001_a", 0, "i1", "o1"), ("task001_a", 1, "i2", "o3"), ("task002_b", 0, "j1", "p1")]


def test_keyed_json(spark):
    d = _tmp()
    with open(os.path.join(d, "ann.json"), "w") as f:
        json.dump({"id1": [[["a", ["s", "r", "o"]]]], "id2": []}, f)
    df = S.read_keyed_json(spark, d + "/ann.json", "ARRAY<ARRAY<ARRAY<STRING>>>")
    assert sorted(r.id for r in df.collect()) == ["id1", "id2"]


def test_tsv_with_header_and_na(spark):
    d = _tmp()
    with open(os.path.join(d, "q.tsv"), "w") as f:
        f.write("QuestionID\texplanation\tarcset\nq1\ta|CENTRAL\tEasy\nq2\tNA\tChallenge\n")
    rows = S.read_tsv(spark, d + "/q.tsv").orderBy("QuestionID").collect()
    assert rows[0].explanation == "a|CENTRAL" and rows[1].explanation is None


def test_results_round_trip(spark):
    d = _tmp()
    df = spark.createDataFrame([("m", "ds", "p", 0.5, 0.75, 0.25)], S.RESULT_SCHEMA)
    S.write_results(df, d + "/out")
    back = S.read_results(spark, d + "/out").first()
    assert (back.model, back.random_demos, back.difference) == ("m", 0.5, 0.25)
    line = spark.read.text(d + "/out").first().value
    assert line == "m\tds\tp\t0.50000\t0.75000\t0.25000"


def test_split_partition_pruning(spark):
    d = _tmp()
    df = spark.range(20).withColumn("split", F.when(F.col("id") % 10 < 8, "train").otherwise("test"))
    S.write_split(df, d + "/ds")
    out = S.read_split(spark, d + "/ds", "test")
    assert sorted(r.id for r in out.collect()) == [8, 9, 18, 19]
    assert "PartitionFilters: [isnotnull(split" in out._jdf.queryExecution().executedPlan().toString()


def test_table_set_first_uid_wins(spark):
    d = _tmp()
    os.makedirs(d + "/tables")
    with open(d + "/tables/t1.tsv", "w") as f:
        f.write("[SKIP] UID\tA\t[SKIP] note\nu1\tred\tx\nu2\tblue\ty\n")
    with open(d + "/tables/t2.tsv", "w") as f:
        f.write("B\t[SKIP] UID\nbig\tu1\nsmall\tu3\n")
    with open(d + "/index.txt", "w") as f:
        f.write("t1.tsv\nt2.tsv\n")
    got = {r.uid: r.text for r in S.read_table_set(spark, d + "/index.txt", d + "/tables").collect()}
    assert got == {"u1": "red", "u2": "blue", "u3": "small"}


def test_prediction_cache_computes_only_missing(spark):
    d = _tmp() + "/cache"
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return missing.withColumn("predicted", F.lit("mock text"))

    todo = spark.createDataFrame([("m", "t", i) for i in range(5)], "model string, task string, idx bigint")
    a = S.with_cache(spark, todo, d, ["model", "task", "idx"], compute, partition_by=["model", "task"])
    assert a.count() == 5
    more = spark.createDataFrame([("m", "t", i) for i in range(8)], "model string, task string, idx bigint")
    b = S.with_cache(spark, more, d, ["model", "task", "idx"], compute, partition_by=["model", "task"])
    assert b.count() == 8 and calls == [5, 3]


def _table_files(d, tables, index):
    os.makedirs(d + "/tablestore")
    for name, text in tables.items():
        with open(f"{d}/tablestore/{name}", "w") as f:
            f.write(text)
    with open(d + "/index.txt", "w") as f:
        f.write(index)
    return d + "/index.txt", d + "/tablestore"


def test_table_set_in_one_scan(spark):
    d = _tmp()
    paths = _table_files(d, {
        "A B.tsv": "[SKIP] UID\tfirst\tsecond\nu1\tone\t\nu2\t\"quoted \"\"x\"\"\ttab\"\tNA\nu3\tshort\n\nu4\t\tlast\n",
        "C.tsv": "first\t[SKIP] note\t[SKIP] UID\nwins not\tn\tu1\nother\tn\tu9\n",
        "unlisted.tsv": "[SKIP] UID\tfirst\nu0\tnever\n",
    }, "A B.tsv\n C.tsv \n\n")
    got = {r.uid: r.text for r in S.read_table_set(spark, *paths).collect()}
    assert got == {"u1": "one ", "u2": 'quoted "x"\ttab ', "u3": "short ", "u4": " last", "u9": "other"}
    os.remove(d + "/index.txt")
    with open(d + "/index.txt", "w") as f:
        f.write("C.tsv\nA B.tsv\n")
    assert {r.uid: r.text for r in S.read_table_set(spark, *paths).collect()}["u1"] == "wins not"


def test_table_set_plan_does_not_grow_with_the_tables(spark):
    sizes = []
    for n in (2, 40):
        d = _tmp()
        tables = {f"T{i}.tsv": f"c{i}\t[SKIP] UID\nv{i}\tu{i}\n" for i in range(n)}
        df = S.read_table_set(spark, *_table_files(d, tables, "\n".join(tables)))
        assert {r.uid: r.text for r in df.collect()} == {f"u{i}": f"v{i}" for i in range(n)}
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert sizes[0] == sizes[1]


def _task_files(d, names):
    for i, name in enumerate(names):
        with open(f"{d}/{name}.json", "w") as f:
            json.dump({"Instances": [{"input": f"in{i}", "output": [f"out{i}", "x"]}, {"input": "none", "output": []}]}, f)


def test_tasks_by_id_open_only_their_files(spark):
    d = _tmp()
    _task_files(d, ["task010_b", "task010_a", "task011_c", "xtask099_d"])
    with open(d + "/task500_broken.json", "w") as f:
        f.write("{ this is no JSON")
    df = S.read_tasks(spark, d, ["task010", "099"])
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("task010_a", 0, "in1", "out0".replace("0", "1")), ("task010_a", 1, "none", None),
                    ("xtask099_d", 0, "in3", "out3"), ("xtask099_d", 1, "none", None)]
    assert sorted(os.path.basename(f) for f in df.inputFiles()) == ["task010_a.json", "xtask099_d.json"]


def test_asked_task_that_is_missing(spark):
    import pytest

    d = _tmp()
    _task_files(d, ["task1_a"])
    with pytest.raises(ValueError, match="task7"):
        S.read_tasks(spark, d, ["task1", "task7"])


def test_cache_generations(spark):
    """A run that fails leaves the cache as it was; two writers keep both results, once each."""
    import pytest

    d = _tmp() + "/cache"
    key = ["m", "idx"]
    todo = lambda n: spark.createDataFrame([("m", i) for i in range(n)] + [(None, 0)], "m string, idx bigint")
    answer = lambda tag: lambda missing: missing.withColumn("predicted", F.concat(F.lit(tag), "idx"))

    def broken(missing):
        return missing.withColumn("predicted", F.raise_error(F.lit("the model died")).cast("string"))

    with pytest.raises(Exception, match="the model died"):
        S.with_cache(spark, todo(3), d, key, broken).count()
    assert S.cache_generations(spark, d) == []
    assert {(r.m, r.idx): r.predicted for r in S.with_cache(spark, todo(3), d, key, answer("a")).collect()} == {
        ("m", 0): "a0", ("m", 1): "a1", ("m", 2): "a2", (None, 0): "a0"}
    with pytest.raises(Exception, match="the model died"):
        S.with_cache(spark, todo(5), d, key, broken).count()
    assert len(S.cache_generations(spark, d)) == 1

    def slower(missing):
        # another writer commits the same keys before this one does
        S.with_cache(spark, todo(5), d, key, answer("b")).count()
        return answer("c")(missing)

    rows = S.with_cache(spark, todo(6), d, key, slower).collect()
    got = {(r.m, r.idx): r.predicted for r in rows}
    assert len(rows) == 7 == len(got)
    assert [got["m", i] for i in range(6)] == ["a0", "a1", "a2", "b3", "b4", "c5"]
    calls = []
    S.with_cache(spark, todo(6), d, key, lambda missing: calls.append(missing.count()) or answer("x")(missing)).count()
    assert calls == [0]


def test_cache_generations_are_merged(spark):
    d, old = _tmp() + "/cache", S.MERGE_GENERATIONS
    try:
        S.MERGE_GENERATIONS = 3
        for n in range(1, 6):
            todo = spark.createDataFrame([(i,) for i in range(n)], "idx bigint")
            got = S.with_cache(spark, todo, d, ["idx"], lambda m: m.withColumn("predicted", F.col("idx") * 2))
            assert sorted((r.idx, r.predicted) for r in got.collect()) == [(i, 2 * i) for i in range(n)]
            assert len(S.cache_generations(spark, d)) <= 3
    finally:
        S.MERGE_GENERATIONS = old


def test_batches_in_order_and_resumed(spark):
    import pytest

    d = _tmp() + "/batches"
    rows = spark.range(203).withColumn("idx", 202 - F.col("id")).withColumn("batch_id", F.floor(F.col("idx") / 8)).drop("id")
    S.write_batches(rows.repartition(7), d, files=5)
    for of in (1, 4):
        seen = {}
        for shard in range(of):
            got = list(S.iterate_batches(spark, d, shard=shard, of=of))
            assert [b for b, _ in got] == list(range(shard, 26, of))
            seen |= {b: [r.idx for r in part] for b, part in got}
        assert seen == {b: list(range(8 * b, min(8 * b + 8, 203))) for b in range(26)}
    assert [b for b, _ in S.iterate_batches(spark, d, shard=3, of=4, start=12)] == [15, 19, 23]
    with pytest.raises(ValueError, match="no shard"):
        S.batch_shard(spark, d, 4, 4)
