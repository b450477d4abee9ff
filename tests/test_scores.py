"""Per-row scores: pinned quirk values and literal models on random inputs."""

import random

from pyspark.sql import functions as F

from demoforge.functions import scores as SC
from tests.models import f_score, lcs


def _score(spark, metric, pairs):
    df = spark.createDataFrame([(i, e, p) for i, (e, p) in enumerate(pairs)], "i int, e string, p string")
    return [r.s for r in SC.with_score(df, metric, "e", "p", "s").orderBy("i").collect()]


def test_char_f1_as_written_and_token_f1_as_commented(spark):
    # expected "ab cd", predicted "ab": characters {a, b, c, d} vs word "ab"
    assert _score(spark, "char_f1", [("ab cd", "ab")]) == [0.0]
    assert abs(_score(spark, "token_f1", [("ab cd", "ab")])[0] - 2 / 3) < 1e-12


def test_f1_against_model(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "ab", "c", "Ab"]
    pairs = [(" ".join(rng.choices(vocab, k=rng.randint(1, 5))), " ".join(rng.choices(vocab, k=rng.randint(1, 5))))
             for _ in range(60)]
    got_t = _score(spark, "token_f1", pairs)
    got_c = _score(spark, "char_f1", pairs)
    for (e, p), t, c in zip(pairs, got_t, got_c):
        assert abs(t - f_score(set(e.lower().split()), p.lower().split())) < 1e-12
        chars = set(ch for ch in e.lower() if ch.split())
        assert abs(c - f_score(chars, p.lower().split())) < 1e-12


def test_rouge_l_against_dp(spark):
    rng = random.Random(7)
    vocab = ["x", "y", "z", "w", "v"]
    pairs = []
    for n in (0, 1, 5, 30, 62, 63, 100):
        for _ in range(4):
            pairs.append((" ".join(rng.choices(vocab, k=n)), " ".join(rng.choices(vocab, k=rng.randint(0, 70)))))
    got = _score(spark, "rouge_l", pairs)
    for (e, p), g in zip(pairs, got):
        et, pt = e.split(), p.split()
        lc = lcs(et, pt)
        want = 0.0 if not et or not pt or not lc else 2 * lc / (len(et) + len(pt))
        assert abs(g - want) < 1e-12, (len(et), len(pt))


def test_accuracy_folding(spark):
    assert _score(spark, "accuracy_folded", [("Yes", "yes"), ("a", "b")]) == [1.0, 0.0]
    assert _score(spark, "accuracy_exact", [("Yes", "yes"), ("a", "a")]) == [0.0, 1.0]


def test_unknown_metric(spark):
    try:
        SC.metric_column("bleu", F.lit("a"), F.lit("b"))
    except ValueError:
        pass
    else:
        raise AssertionError


def test_empty_prediction_set_gives_null_mean(spark):
    from demoforge.operators.evaluate import mean_score
    df = spark.createDataFrame([], "expected string, predicted string")
    r = mean_score(df, "accuracy_exact").first()
    assert r.n == 0 and r.score is None


def test_first_n_limits_the_evaluated_samples_not_the_pool(spark):
    from demoforge.operators.evaluate import strategy_gap
    rows = [(i, "t%d" % i, "l%d" % (i % 2), "c%d" % (i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "idx bigint, input string, label string, category string")
    assert strategy_gap(df, 3, first_n=10).first().n_samples == 10
    assert strategy_gap(df, 3).first().n_samples == 40
