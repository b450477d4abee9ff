"""Dense positions, running sums, keyed joins with salting, edit distance."""

import random

from pyspark.sql import functions as F

from demoforge.operators import concepts as CN
from demoforge.operators import windows as W
from demoforge.operators.joins import keyed_join
from tests.models import edit_distance


def test_dense_index_sparse_ids_and_groups(spark):
    rng = random.Random(1)
    ids = sorted(rng.sample(range(10**9), 500))
    df = spark.createDataFrame([(i, "g%d" % (i % 3)) for i in ids], "idx bigint, g string")
    got = {r.idx: r.pos for r in W.dense_index(df, "idx").collect()}
    assert [got[i] for i in ids] == list(range(500))
    by = W.dense_index(df, "idx", by=["g"], out="p", size_out="n").collect()
    for g in ("g0", "g1", "g2"):
        mine = sorted((r.idx, r.p, r.n) for r in by if r.g == g)
        assert [p for _, p, _ in mine] == list(range(len(mine)))
        assert all(n == len(mine) for _, _, n in mine)


def test_block_clusters_from_the_end(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "idx bigint")
    got = {r.idx: r.cluster for r in W.block_clusters(df, 3).collect()}
    assert [got[i] for i in range(10)] == [2, 2, 1, 1, 1, 1, 0, 0, 0, 0]


def test_running_sum_matches_window(spark):
    rows = [(k, i, v) for k in ("a", "b") for i, v in enumerate(range(50, 0, -1))]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {(r.k, r.o): r.running for r in W.running_sum(df, "v", ["k"], ["o"]).collect()}
    for k in ("a", "b"):
        acc = 0
        for o, v in enumerate(range(50, 0, -1)):
            acc += v
            assert got[(k, o)] == acc


def test_keyed_join_salts_hot_keys(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else "k%d" % i) for i in range(3000)], "idx bigint, key string")
    small = big.groupBy("key").agg(F.count("*").alias("_w"), F.max("idx").alias("m"))
    out = keyed_join(big, small, "key", weight="_w", salt_by=F.col("idx"), broadcast_limit=0)
    assert out.count() == 3000
    assert out.where("key = 'hot'").select(F.max("m")).first()[0] == 2999
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan or "_salt" in plan


def test_min_edit_distance_against_model(spark):
    rng = random.Random(2)
    words = ["select", "filter", "project", "count", "max"]
    vals = list({" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(60)})
    df = spark.createDataFrame([(v,) for v in vals], "concept string")
    got = {r.concept: r.min_dist for r in CN.min_edit_distance(df).collect()}
    for v in vals:
        assert got[v] == min(edit_distance(v, o) for o in vals if o != v)


def test_min_edit_distance_lone_value_is_null(spark):
    df = spark.createDataFrame([("a b",), ("a b",)], "concept string")
    assert [r.min_dist for r in CN.min_edit_distance(df).collect()] == [None]


def test_dedup_first_keeps_lowest_idx(spark):
    df = spark.createDataFrame([(3, "k", "c"), (1, "k", "a"), (2, "j", "b")], "idx bigint, key string, v string")
    got = sorted((r.key, r.v) for r in W.dedup_first(df, "key").collect())
    assert got == [("j", "b"), ("k", "a")]


def _neighbours_model(sets, k):
    out = {}
    for q, a in sets.items():
        scored = []
        for c, b in sets.items():
            if c == q or not a or not b:
                continue
            s = len(a & b) / max(len(a), len(b))
            if s > 0:
                scored.append((-s, c))
        out[q] = [c for _, c in sorted(scored)[:k]]
    return out


def test_overlap_neighbours_light_and_heavy_paths(spark):
    from demoforge.operators.neighbours import overlap_neighbours
    rng = random.Random(4)
    sets = {}
    for q in range(80):
        facts = set(rng.sample(range(12), rng.randint(1, 4)))
        if rng.random() < 0.6:
            facts.add(100)  # a fact held by most questions
        sets[q] = facts
    df = spark.createDataFrame([(q, sorted(f)) for q, f in sets.items()], "q bigint, facts array<bigint>")
    want = _neighbours_model(sets, 3)
    for fanout in (1000, 10, 3):
        got = {}
        for r in overlap_neighbours(df, "q", "facts", 3, max_fanout=fanout).collect():
            got.setdefault(r.q, []).append((r.rank, r.other))
        got = {q: [c for _, c in sorted(v)] for q, v in got.items()}
        for q in sets:
            assert got.get(q, []) == want[q], (fanout, q)


def test_exact_quantiles_match_numpy_with_a_hot_group(spark):
    import numpy as np

    from demoforge.operators.reports import box_stats, exact_quantiles

    rng = random.Random(8)
    rows = [("hot", rng.random()) for _ in range(3000)] + [("g%d" % (i % 5), rng.gauss(0, 1)) for i in range(200)]
    rows += [("tie", 0.5)] * 7 + [("one", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    for g in {r[0] for r in rows}:
        vals = np.array([v for k, v in rows if k == g])
        for name, q in (("a", 0.25), ("b", 0.5), ("c", 0.9)):
            assert abs(got[g][name] - np.quantile(vals, q)) < 1e-9, (g, name)
        assert got[g].n == len(vals)
    box = {r.g: r for r in box_stats(df, ["g"], "v").collect()}
    vals = np.array([v for k, v in rows if k == "g1"])
    q1, q3 = np.quantile(vals, 0.25), np.quantile(vals, 0.75)
    assert abs(box["g1"].whisker_lo - round(vals[vals >= q1 - 1.5 * (q3 - q1)].min(), 6)) < 1e-9
    assert abs(box["g1"].whisker_hi - round(vals[vals <= q3 + 1.5 * (q3 - q1)].max(), 6)) < 1e-9


def test_min_edit_distance_with_split_bands(spark, monkeypatch):
    monkeypatch.setattr(CN, "PAIRS_PER_TASK", 5)
    rng = random.Random(12)
    words = ["ab", "abc", "b", "cd"]
    vals = list({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(50)})
    df = spark.createDataFrame([(v,) for v in vals], "concept string")
    got = {r.concept: r.min_dist for r in CN.min_edit_distance(df).collect()}
    for v in vals:
        assert got[v] == min(edit_distance(v, o) for o in vals if o != v)


def test_a_fact_gives_each_question_k_neighbours_not_all_its_pairs(spark):
    from demoforge.operators import neighbours as N
    rows = [(q, q % 4 + 1, "f") for q in range(60)] + [(q, q % 4 + 1, f"g{q}_{i}") for q in range(60) for i in range(q % 4)]
    members = spark.createDataFrame(rows, "q bigint, na int, f string").selectExpr("*", "true plain")
    got = N._plain_candidates(members, 3).collect()
    assert len(got) == 180
    size = {q: q % 4 + 1 for q in range(60)}
    for q in size:
        want = sorted((c for c in size if c != q), key=lambda c: (max(size[q], size[c]), c))[:3]
        assert sorted(r.c for r in got if r.q == q) == sorted(want)


def test_dedup_first_groups_texts_by_digest(spark, capsys):
    from demoforge.operators import windows as W
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, ""), (5, None)], "idx bigint, t string")
    first = W.dedup_first(df, "t", "idx")
    assert sorted(r.idx for r in first.collect()) == [1, 3, 4]
    first.explain()
    assert "md5(" in capsys.readouterr().out
