"""Bounded demo selection against the literal backwards scan."""

import random


from demoforge.operators import demos as D
from demoforge.operators.predict import demo_majority
from tests.models import select_demos_literal


def _random_data(rng, n, cats, inputs, labels, as_list=False):
    data = []
    for _ in range(n):
        cat = rng.choice(cats)
        if as_list:
            cat = sorted(rng.sample(cats, rng.randint(0, 2)))
        data.append((rng.choice(inputs), rng.choice(labels), cat))
    return data


def _spark_choice(spark, data, k, strategy, as_list=False):
    schema = "idx bigint, input string, label string, category " + ("array<string>" if as_list else "string")
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(data)], schema)
    if as_list:
        sel = D.select_demos_overlap(df, k)
    else:
        sel = D.select_demos(df, k, strategy)
    got = {r.idx: [(d.input, d.label) for d in r.demos] for r in sel.collect()}
    return got


def test_matches_literal_scan_scalar_and_null(spark):
    rng = random.Random(5)
    for trial in range(6):
        data = _random_data(rng, rng.randint(1, 40), ["a", "b", None], list("pqrstu"), list("xyz"))
        for strategy in ("random", "cluster-random"):
            for k in (1, 3):
                want = select_demos_literal(data, k, strategy)
                got = _spark_choice(spark, data, k, strategy)
                for i, demos in enumerate(want):
                    if demos is None:
                        assert i not in got, (trial, strategy, k, i)
                    else:
                        assert got[i] == [(d[0], d[1]) for d in demos], (trial, strategy, k, i)


def test_matches_literal_scan_list_categories(spark):
    rng = random.Random(11)
    for trial in range(4):
        data = _random_data(rng, rng.randint(1, 35), ["a", "b", "c"], list("pqrst"), list("xy"), as_list=True)
        want = select_demos_literal(data, 3, "cluster-random")
        got = _spark_choice(spark, data, 3, "cluster-random", as_list=True)
        for i, demos in enumerate(want):
            if demos is None:
                assert i not in got
            else:
                assert got[i] == [(d[0], d[1]) for d in demos]


def test_k_larger_than_category_drops_samples(spark):
    df = spark.createDataFrame([(0, "a", "x", "c"), (1, "b", "y", "c")], "idx bigint, input string, label string, category string")
    assert D.select_demos(df, 3, "cluster-random").count() == 0
    assert D.select_demos(df, 1, "cluster-random").count() == 2


def test_empty_input(spark):
    df = spark.createDataFrame([], "idx bigint, input string, label string, category string")
    assert D.select_demos(df, 3, "random").count() == 0


def test_unknown_strategy_is_an_error(spark):
    df = spark.createDataFrame([(0, "a", "x", "c")], "idx bigint, input string, label string, category string")
    try:
        D.select_demos(df, 1, "nearest")
    except ValueError as e:
        assert "nearest" in str(e)
    else:
        raise AssertionError("expected ValueError")


def test_prompt_and_word_count(spark):
    df = spark.createDataFrame([(0, "one two", "x", "c"), (1, "three", "y", "c"), (2, "four  five six", "z", "c")],
                               "idx bigint, input string, label string, category string")
    s = D.select_demos(df, 2, "cluster-random").where("idx = 0").select(
        D.fewshot_prompt("demos").alias("p"), D.prompt_word_count("demos").alias("n")).first()
    assert s.p == "Input: four  five six Prediction: z\nInput: three Prediction: y\nInput: one two Prediction:"
    assert s.n == len(s.p.split())


def test_majority_latest_on_ties(spark):
    df = spark.createDataFrame([(0, "a", "x", "c"), (1, "b", "y", "c"), (2, "c", "y", "c"), (3, "d", "x", "c")],
                               "idx bigint, input string, label string, category string")
    # sample 0 sees demos 3 (x), 2 (y): a tie, the latest (3) wins
    r = D.select_demos(df, 2, "cluster-random").where("idx = 0").select(demo_majority("demos").alias("p")).first()
    assert r.p == "x"


def test_custom_predictor_runs_in_arrow_batches(spark):
    from demoforge.operators.predict import predict

    df = spark.createDataFrame([(i, "p%d" % i) for i in range(50)], "idx bigint, prompt string")

    def upper_model(prompts):
        return prompts.str.upper()

    out = {r.idx: r.predicted for r in predict(df, upper_model).collect()}
    assert out[7] == "P7" and len(out) == 50
    assert predict(df, "mock", demos_col="prompt").first().predicted == "mock text"


def test_salted_path_with_a_hot_category(spark, monkeypatch):
    """Force the shuffle path of the keyed join (no broadcast): the hot
    category is salted and the choice still equals the literal scan."""
    from demoforge.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_LIMIT_BYTES", 0)
    rng = random.Random(9)
    data = [(rng.choice(list("pqrstuvw")), rng.choice("xy"), "hot" if rng.random() < 0.7 else rng.choice("abcd"))
            for _ in range(120)]
    want = select_demos_literal(data, 3, "cluster-random")
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(data)], "idx bigint, input string, label string, category string")
    sel = D.select_demos(df, 3, "cluster-random")
    plan = sel._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    got = {r.idx: [(d.input, d.label) for d in r.demos] for r in sel.collect()}
    for i, demos in enumerate(want):
        assert (i in got) == (demos is not None)
        if demos is not None:
            assert got[i] == [(d[0], d[1]) for d in demos]


def test_overlap_lists_hold_no_texts(spark):
    data = _random_data(random.Random(3), 40, ["a", "b", "c", "d"], list("pqrstu"), list("xyz"), as_list=True)
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(data)],
                               "idx bigint, input string, label string, category array<string>")
    full = {r.idx: r.demos for r in D.select_demos_overlap(df, 3).collect()}
    slim = {r.idx: r.demos for r in D.select_demos_overlap(D.slim(df), 3).collect()}
    assert full and {i: [d.idx for d in ds] for i, ds in full.items()} == {i: [d.idx for d in ds] for i, ds in slim.items()}
    assert all(d.input == data[d.idx][0] for ds in full.values() for d in ds)
    assert all("input" not in d for ds in slim.values() for d in ds)
