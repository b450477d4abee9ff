"""Rounds of hardest demonstrations move counts and digests, not texts."""

import random

from pyspark.sql import functions as F

from demoforge.operators import scorer as SR
from demoforge.operators import training as TR

COLS = ["idx", "n_demos", "demo_idxs", "demos_chars"]


def samples(spark, n=90, seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["en", "de"]
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 14))),
             [None, "", "en w1", "de", "fr"][rng.randrange(5)], "ab"[i % 2] if i % 13 else None) for i in range(n)]
    return spark.createDataFrame(rows, "idx bigint, input string, label string, category string").repartition(3)


def shown(df):
    return sorted(map(tuple, df.select(COLS).collect()))


def test_counts_between_bounds_choose_what_words_choose(spark):
    s = samples(spark)
    s = s.unionByName(s.where("idx % 4 = 0"))  # rows may repeat
    plain = shown(TR.hard_sets(s, hi=3, candidates=7, max_chars=150, scorer=lambda p, t: TR.unigram_log_score(p, t)))
    assert plain and shown(TR.hard_sets(s, hi=3, candidates=7, max_chars=150)) == plain


def test_rounds_of_counts_hold_no_texts(spark):
    kind = TR._pairs_of(TR.unigram_log_score)
    ci = TR._hard_inputs(samples(spark), "input", "label", kind)
    assert not {"input", "label"} & set(ci.columns)
    assert {w for r in ci.collect() for w in r._own.hits} <= {"en", "w1", "de", "fr"}


def test_ids_beyond_the_broadcast_give_the_same(spark, monkeypatch):
    s = samples(spark, 40)
    model = SR.BatchScorer("shared", lambda: lambda ps, ts: [sum(w in p.split() for w in t.split()) for p, t in zip(ps, ts)])
    want = [shown(TR.hard_sets(s, lo=1, hi=2, candidates=5, scorer=x)) for x in (TR.unigram_log_score, model)]
    monkeypatch.setattr(TR, "BROADCAST_IDS", 0)
    monkeypatch.setattr(TR, "BROADCAST_WORDS", 0)
    assert [shown(TR.hard_sets(s, lo=1, hi=2, candidates=5, scorer=x)) for x in (TR.unigram_log_score, model)] == want


def test_pairs_are_told_apart_without_their_texts(spark, monkeypatch):
    """What is asked for holds digests; a text reaches the model whole."""
    s = samples(spark, 30)
    seen = []
    keyed = TR.score_keyed
    monkeypatch.setattr(TR, "score_keyed", lambda asked, todo, *rest: (seen.append((asked.columns, todo.columns)), keyed(asked, todo, *rest))[1])
    model = SR.BatchScorer("length", lambda: lambda ps, ts: [-len(p) - len(t) for p, t in zip(ps, ts)])
    got = TR.hard_sets(s, lo=1, hi=1, candidates=25, scorer=model)
    rows = {r.idx: r for r in s.collect()}
    demo = lambda r: "%s %s " % (r.input, r.label)
    assert got.count() and all("input" not in c and "prompt" not in c for pair in seen for c in pair)
    for r in got.collect():
        if rows[r.idx].category is not None:
            longest = max(len(demo(x)) for x in rows.values() if x.category == rows[r.idx].category)
            assert len(demo(rows[r.demo_idxs[0]])) <= longest
    assert {r.idx for r in got.collect()} == {i for i, r in rows.items() if r.category is not None}
