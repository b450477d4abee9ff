"""Batch scorers and metrics over lists."""

import glob
import json
import os
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from demoforge.operators import evaluate as EV
from demoforge.operators import list_metrics as LM
from demoforge.operators import scorer as SR
from demoforge.operators import training as TR


def counting(folder):
    """A loader that leaves a file for every load and every call."""

    def load():
        def note(kind, rows):
            with open(os.path.join(folder, f"{kind}-{uuid.uuid4().hex}"), "w") as f:
                json.dump(rows, f)

        note("load", os.getpid())

        def score(prompts, targets):
            note("call", list(zip(prompts, targets)))
            return [sum(w in p.split() for w in t.split()) for p, t in zip(prompts, targets)]

        return score

    return load


def calls(folder):
    out = []
    for f in glob.glob(os.path.join(folder, "call-*")):
        with open(f) as h:
            out.append([tuple(x) for x in json.load(h)])
    return out


def samples(spark, n=40, seed=3):
    rng = random.Random(seed)
    words = "red green blue one two three".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(4)), rng.choice(words), "c%d" % (i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "idx bigint, input string, label string, category string").repartition(3)


def test_every_different_pair_is_scored_once(spark, tmp_path):
    rows = [(i, f"prompt {i % 7}", "t" if i % 2 else None) for i in range(60)]
    pairs = spark.createDataFrame(rows, "idx int, p string, t string").repartition(4)
    scorer = SR.BatchScorer("m", counting(str(tmp_path)), batch_size=3)
    got = {r.idx: r.score for r in SR.score_pairs(pairs, scorer, "p", "t").collect()}
    assert len(got) == 60 and set(got.values()) == {0.0}
    done = calls(str(tmp_path))
    assert all(len(c) <= 3 for c in done)
    assert Counter(x for c in done for x in c) == Counter({(p, t or ""): 1 for _, p, t in rows})


def test_hard_sets_take_a_model_over_all_slots(spark, tmp_path):
    s = samples(spark)
    cache, logs = str(tmp_path / "cache"), [str(tmp_path / x) for x in ("a", "b", "c")]
    for x in logs:
        os.mkdir(x)
    want = sorted(tuple(r) for r in TR.hard_sets(s, lo=2, hi=3, candidates=6, scorer=TR.shared_word_score).collect())
    for x in logs[:2]:
        scorer = SR.BatchScorer("shared", counting(x), batch_size=8, cache=cache)
        assert sorted(tuple(r) for r in TR.hard_sets(s, lo=2, hi=3, candidates=6, scorer=scorer).collect()) == want
    first = [p for c in calls(logs[0]) for p in c]
    assert first and len(first) == len(set(first)) and not calls(logs[1])
    # another model does not read these scores
    other = SR.BatchScorer("other", counting(logs[2]), batch_size=8, cache=cache)
    TR.hard_sets(s, lo=2, hi=2, candidates=3, scorer=other).count()
    assert calls(logs[2])


def test_scores_that_are_missing_or_too_few(spark):
    def none_at_all():
        return lambda prompts, targets: [None if "two" in p else float("nan") for p in prompts]

    def one_short():
        return lambda prompts, targets: [0.0] * (len(prompts) - 1)

    got = TR.hard_sets(samples(spark), lo=2, hi=2, candidates=3, scorer=SR.BatchScorer("none", none_at_all))
    assert got.count() == 40  # the lowest draw wins
    with pytest.raises(Exception, match="gave 0 scores for 1 pairs|scores for"):
        pairs = spark.createDataFrame([(1, "p", "t")], "idx int, p string, t string")
        SR.score_pairs(pairs, SR.BatchScorer("short", one_short), "p", "t").collect()


def predictions(spark, n=90):
    rng = random.Random(2)
    words = "a b c d e f".split()
    rows = [(i, ["x", "y", None][i % 3], " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))),
             None if i % 17 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "idx bigint, task string, expected string, predicted string").repartition(5)


def pooled_function():
    """Made inside a function, so that workers get it by value."""
    def pooled(expected, predicted):
        tp = fp = fn = 0
        for e, p in zip(expected, predicted):
            e, p = set((e or "").split()), (p or "").split()
            hit = sum(w in e for w in p)
            tp, fp, fn = tp + hit, fp + len(p) - hit, fn + len(e - set(p))
        return tp / (tp + 0.5 * (fp + fn)) if tp + fp + fn else None

    return pooled


pooled = pooled_function()


def fold():
    def add(state, expected, predicted):
        for e, p in zip(expected, predicted):
            e, p = set((e or "").split()), (p or "").split()
            hit = sum(w in e for w in p)
            state = (state[0] + hit, state[1] + len(p) - hit, state[2] + len(e - set(p)))
        return state

    return LM.FoldMetric("pooled", lambda: (0, 0, 0), add, lambda a, b: tuple(x + y for x, y in zip(a, b)),
                         lambda s: s[0] / (s[0] + 0.5 * (s[1] + s[2])) if sum(s) else None)


FORMS = [LM.micro_f1(), fold(), LM.ListFunction(pooled)]


@pytest.mark.parametrize("metric", FORMS, ids=lambda m: type(m).__name__)
def test_whole_tasks(spark, metric):
    rows, df = predictions(spark)
    got = {r.task: (r.n, r.score) for r in LM.list_score(df, metric, ["task"]).collect()}
    for task in ("x", "y", None):
        own = [r for r in rows if r[1] == task]
        n, score = got[task]
        assert n == len(own) and score == pytest.approx(pooled([r[2] for r in own], [r[3] for r in own]))
    one = LM.list_score(df, metric).first()
    assert (one.n, one.score) == (90, pytest.approx(pooled([r[2] for r in rows], [r[3] for r in rows])))


def test_bootstrap_rounds_agree_over_the_forms(spark):
    _, df = predictions(spark)
    got = [{(r.task, r.round_id): round(r.score, 9) for r in LM.list_bootstrap(df, m, 5, 11, ["task"], seed=4, stream="s").collect()}
           for m in FORMS]
    assert len(got[0]) == 15 and got[0] == got[1] == got[2]


def test_bootstrap_draws_rows_of_the_list(spark):
    """One row drawn: the score of one of the rows, and all rows turn up."""
    rows, df = predictions(spark, 6)
    def first_word(expected, predicted):
        assert len(expected) == len(predicted) == 1
        return float(len(expected[0]))

    one = LM.ListFunction(first_word)
    got = {r.score for r in LM.list_bootstrap(df.where("task = 'x'"), one, 60, 1, seed=1).collect()}
    assert got == {float(len(r[2])) for r in rows if r[1] == "x"}


def test_a_mean_as_list_metric_equals_the_row_metric(spark):
    s = samples(spark, 60).withColumn("task", F.concat(F.lit("t"), F.col("idx") % 2))
    exact = LM.CountMetric("exact", lambda e, p: {"hit": e.eqNullSafe(p).cast("int"), "n": F.lit(1)}, lambda c: c["hit"] / c["n"])
    for rounds in (0, 4):
        rows = [sorted(map(tuple, EV.strategy_gap(s, 3, "demo_majority", m, by=["task"], bootstrap_rounds=rounds,
                                                  bootstrap_size=10).collect())) for m in ("accuracy_exact", exact)]
        assert rows[0] and rows[0] == rows[1]


def test_plain_function_refuses_an_unbounded_task(spark, monkeypatch):
    _, df = predictions(spark)
    monkeypatch.setattr(LM, "GROUP_ROWS", 20)
    with pytest.raises(ValueError, match="CountMetric or FoldMetric"):
        LM.list_score(df, LM.ListFunction(pooled), ["task"])


def test_empty_input(spark):
    _, df = predictions(spark)
    none = df.where("false")
    for m in FORMS:
        assert LM.list_score(none, m, ["task"]).count() == 0
        assert LM.list_bootstrap(none, m, 3, 4, ["task"]).count() == 0
