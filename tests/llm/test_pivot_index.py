import numpy as np
import pytest

from demoforge.llm import pivot_index as P
from tests.conftest import SF_SMALL


def brute(ids, vectors, cos=0.9):
    """Links, components and kept by comparing all vectors."""
    good = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for v in vectors]
    at = np.flatnonzero(good)
    u = np.array([np.asarray(vectors[i], dtype=float) / np.linalg.norm(vectors[i]) for i in at])
    near = u @ u.T >= cos if len(at) else np.zeros((0, 0), bool)
    np.fill_diagonal(near, False)
    # equal vectors are linked whatever rounding says
    label = np.arange(len(at))
    while len(at):
        new = np.array([min(label[near[i]].min() if near[i].any() else label[i], label[i]) for i in range(len(at))])
        if (new == label).all():
            break
        label = new
    least = {}
    for k, x in zip(at, label):
        least[x] = min(least.get(x, ids[k]), ids[k])
    out = {i: (0, i) for i in ids}
    for k, x, n in zip(at, label, near.sum(axis=1)):
        out[ids[k]] = (int(n), least[x])
    return out


def run(spark, ids, vectors, kind="array<double>", **kw):
    rows = [(i, [float(x) if x is not None else None for x in v] if v is not None else None, "x") for i, v in zip(ids, vectors)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}, key string").repartition(3)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in P.near_duplicates(df, **kw).collect()}


def clusters(seed=0, dim=32):
    rng = np.random.RandomState(seed)
    out = [rng.randn(dim) for _ in range(150)]
    for size, noise in ((120, 0.01), (40, 0.2), (20, 0.3), (10, 0.0)):
        c = rng.randn(dim)
        out += [c + noise * rng.randn(dim) for _ in range(size)]
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    v = clusters()
    ids = list(range(len(v)))
    got, want = run(spark, ids, v), brute(ids, v)
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert sum(got[i][1] == want[i][1] for i in ids) >= 0.97 * len(ids)
    assert all(g[2] == (i == g[1]) for i, g in got.items())


def test_recall_at_the_threshold(spark):
    """Pairs planted just above the least cosine, the hardest for the index."""
    rng = np.random.RandomState(1)
    a = rng.randn(600, 64)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.randn(600, 64)
    n -= (n * a).sum(axis=1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    v = [*a, *(0.91 * a + np.sqrt(1 - 0.91 ** 2) * n)]
    got = run(spark, list(range(1200)), v)
    assert sum(g[0] for g in got.values()) >= 0.9 * 1200


def test_every_length_is_indexed(spark):
    """Near links within two lengths and a pair of a third; none across."""
    v = clusters() + clusters(seed=1, dim=16)[:250] + [np.array([1.0, 0.0, 0.0]), np.array([1.0, 0.01, 0.0]), np.array([1.0] * 5)]
    ids = list(range(len(v)))
    got = run(spark, ids, v)
    for dim in (32, 16, 3, 5):
        at = [i for i in ids if len(v[i]) == dim]
        want = brute(at, [v[i] for i in at])
        assert all(got[i][0] <= want[i][0] for i in at)
        assert sum(got[i][0] for i in at) >= 0.97 * sum(w[0] for w in want.values())
        assert sum(got[i][1] == want[i][1] for i in at) >= 0.97 * len(at)


def test_odd_vectors(spark):
    v = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 1.0], [2.0, 2.0], [1.0, 1.0], [1.0, -1.0],
         [1e300, 1e300], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1e-300, 1e-300]]
    got = run(spark, list(range(len(v))), v)
    assert {i: g[:2] for i, g in got.items()} == {
        **{i: (0, i) for i in (0, 1, 2, 3, 4, 5, 9)}, **{i: (4, 6) for i in (6, 7, 8, 10, 13)}, 11: (1, 11), 12: (1, 11)}
    assert run(spark, [], []) == {}


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (2, None)], "vec_id bigint, embedding array<float>")
    rows = sorted(repr(tuple(r)) for r in P.near_duplicates(df).collect())
    assert rows == sorted(map(repr, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 0, 2, True)]))


def test_driver_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id) for r in P.near_duplicates(df).collect()}
    rows = df.collect()
    assert got == brute([r.vec_id for r in rows], [r.embedding for r in rows])


def test_written_tables_are_never_broadcast(spark, monkeypatch):
    """A table's file says little about what its exploded rows take in the driver."""
    from demoforge.llm.common import Workspace
    plans, save = [], Workspace.save

    def seen(self, df, tag="t"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, tag)

    monkeypatch.setattr(Workspace, "save", seen)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [(i, [float(y) for y in base[i % 30] + 0.01 * rng.normal(size=8)]) for i in range(60)]
    out = P.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not [p for p in plans if "BroadcastHashJoin" in p]
