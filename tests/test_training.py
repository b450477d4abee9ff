"""Training-set builders against a literal model of the slot loop."""

from pyspark.sql import functions as F

from demoforge.operators import training as TR


def test_informative_sets_follow_the_slot_rule(spark):
    rows = [(i, "text %d" % i, "lab%d" % (i % 2), "c%d" % (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "idx bigint, input string, label string, category string")
    sets = {r.idx: r for r in TR.informative_sets(df, seed=1).collect()}
    counts = {r.idx: r.n_demos for r in TR.demo_counts(df, seed=1).collect()}
    by_cat = {}
    for i, _, _, c in rows:
        by_cat.setdefault(c, []).append(i)
    draws = {(r.i, r.s): r.d for r in spark.createDataFrame(
        [(i, s) for i in range(60) for s in range(5)], "i bigint, s int").select(
        "i", "s", TR.draw(F.lit("1"), F.lit("informative"), F.col("i"), F.col("s"), n=19).alias("d")).collect()}
    for i, _, _, c in rows:
        members = by_cat[c]
        assert len(members) == 20
        want = []
        for s in range(counts[i]):
            sel = 1 + draws[(i, s)]
            if members[sel] == i:
                sel -= 1
            want.append(members[sel])
        assert list(sets[i].demo_idxs) == want
        assert 2 <= counts[i] <= 5


def test_length_guard_skips_only_before_last(spark):
    rows = [(i, "x" * 50, "y", "c") for i in range(10)]
    df = spark.createDataFrame(rows, "idx bigint, input string, label string, category string")
    # each demo is 53 characters; the guard checks the sum before each addition
    full = {r.idx: r for r in TR.informative_sets(df, lo=3, hi=3, max_chars=106).collect()}
    cut = TR.informative_sets(df, lo=3, hi=3, max_chars=105).count()
    assert len(full) == 10 and cut == 0


def test_hard_sets_pick_least_likely(spark):
    rows = [(0, "q", "a", "c"), (1, "p", "a", "c"), (2, "r", "b", "c")]
    df = spark.createDataFrame(rows, "idx bigint, input string, label string, category string")
    h = TR.hard_sets(df, lo=1, hi=1, candidates=30).collect()
    # target "a": a demo whose label is "a" raises its count, so the hardest is idx 2 (label b) when drawn
    for r in h:
        assert list(r.demo_idxs) in ([2], [0], [1])
    r0 = [r for r in h if r.idx == 0][0]
    assert list(r0.demo_idxs) == [2]


def test_target_word_scorer_meets_no_other_words(spark):
    from demoforge.operators import training as TR
    rows = [(i, f"w{i % 4} en de w{i % 3}" if i % 7 else None, ["en x", "de", "fr", None][i % 4], "ab"[i % 2] if i % 5 else None)
            for i in range(40)]
    df = spark.createDataFrame(rows, "idx bigint, input string, label string, category string")
    ci = TR._hard_inputs(df, "input", "label", TR._pairs_of(TR.shared_word_score))
    assert {w for r in ci.collect() for w in r._own or []} == {"en", "de"}
    kept = TR.hard_sets(df, candidates=5, scorer=TR.shared_word_score)
    plain = TR.hard_sets(df, candidates=5, scorer=lambda p, t: TR.shared_word_score(p, t))
    cols = ["idx", "n_demos", "demo_idxs", "demos_chars"]
    assert sorted(map(tuple, kept.select(cols).collect())) == sorted(map(tuple, plain.select(cols).collect())) != []
