import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from demoforge.llm import exact_dedup, simhash
from demoforge.llm.common import Workspace, connected_components
from tests.conftest import SF_SMALL
from tests.llm.edge import edge_docs, edge_rows, empty_docs, prose
from tests.oracle_check import check, duck


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 500, 20_000])
def test_binary_fuse(n):
    rng = np.random.RandomState(n)
    keys = rng.randint(0, 2 ** 63 - 1, n).astype(np.uint64)
    f = exact_dedup.BinaryFuse.from_bytes(exact_dedup.BinaryFuse.of(np.concatenate([keys, keys])).to_bytes())
    assert f.contains(keys).all()
    assert f.contains(rng.randint(0, 2 ** 63 - 1, 20_000).astype(np.uint64)).mean() < 0.01


def test_op9_oracle(spark):
    r = check(spark, duck(SF_SMALL), SF_SMALL, "op9_exact_dedup", E.queries()["op9_exact_dedup"], E.oracle_sql()["op9_exact_dedup"])
    assert r["status"] == "ok", r


def weak(text):
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
@pytest.mark.parametrize("snapshot", [None, "true", "false"])
def test_exact_groups(spark, digest, snapshot):
    got = exact_dedup.groups(edge_docs(spark), snapshot and F.expr(snapshot), digest).collect()
    group = collections.defaultdict(list)
    for r in edge_rows():
        group[lowered(r[1])].append(r[0])
    want = []
    for t, ids in group.items():
        top = max((i for i in ids if i is not None), default=None)
        want += [(i, top, len(ids), i == top, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got)


def test_exact_dedup_rows(spark):
    docs = edge_docs(spark)
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    group = collections.defaultdict(set)
    for r in edge_rows():
        group[lowered(r[1])].add(r[0])
    want = {(max((i for i in ids if i is not None), default=None), t) for t, ids in group.items()}
    assert sorted(map(repr, want)) == sorted(repr((i, lowered(t))) for i, t in got)
    assert exact_dedup.dedup(empty_docs(spark)).count() == 0


def spec_fingerprint(text):
    import xxhash

    w = [x for x in re.split("[\x20\x09-\x0d]+", lowered(text)) if x]
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    fps = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            break
        label = new
    least = {}
    for i, x in zip(ids, label):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return [least.get(x) for x in label]


def near_docs(spark):
    """Long texts and many copies with one or two words changed."""
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = prose(rng, 1500).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"w{rng.random()}"
            texts.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("group_rows", [2048, 1])
def test_simhash_components(spark, monkeypatch, group_rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    rows = near_docs(spark) + [(1000 + i, r[1]) for i, r in enumerate(edge_rows())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(docs).collect()}
    fps = [spec_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want)}
    assert len({c for _, c in got.values()}) < len({f for f, _ in got.values()})


def test_simhash_links_random_fingerprints(spark):
    """Every pair within two bits ends in one component, none beyond."""
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(300)]
    fps = list({c ^ (1 << rng.randrange(64) if k else 0) ^ (1 << rng.randrange(64) if k > 1 else 0) for c in centres for k in range(3)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    ws = Workspace(spark, "test")
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp bigint, least bigint")
    comp = {r.node: r.component for r in connected_components(ws, simhash.links(ws, df)).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups = collections.defaultdict(set)
    for i, f in enumerate(signed):
        groups[comp.get(f, f)].add(i)
    expected = collections.defaultdict(set)
    for i, c in enumerate(want):
        expected[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_allocation_by_dynamic_programming():
    # thresholds -1, 0, 1, 2 of two partitions must add up to 1
    cost, t = simhash.allocate([[0, 10, 20, 90], [0, 1, 50, 60]], 1)
    assert (cost, t) == (21, [1, 0])
    assert simhash.allocate([[0, 5, 9, 9], [0, 5, 9, 9], [0, 1, 1, 1]], 0)[1] == [-1, -1, 2]


def test_near_dedup_rows(spark):
    docs = edge_docs(spark)
    out = simhash.near_dedup(docs)
    assert out.columns == docs.columns
    comp = simhash.components(docs).collect()
    stay = {r.doc_id for r in comp if r.doc_id == r.component_id}
    assert {r.doc_id for r in out.collect() if r.doc_id is not None} == stay
    assert simhash.near_dedup(empty_docs(spark)).count() == 0


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300, 340)] + [(500, k) for k in range(501, 560)] + [
        (rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(-5, -9), (7, 7)]
    got = {r.node: r.component for r in connected_components(Workspace(spark, "test"), spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent) if any(x in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert connected_components(Workspace(spark, "test"), spark.createDataFrame([], "a bigint, b bigint")).count() == 0
