import collections
import hashlib
import random

import pytest

from demoforge.llm import suffix_repeats as R
from tests.llm.edge import edge_docs, edge_rows, empty_docs, prose


def brute(texts, window=200):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i:i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i:i + window]] > 1:
                mark[i:i + window] = b"\1" * window
        kept = bytes(x for x, m in zip(b, mark) if not m)
        runs = sum(m and not p for p, m in zip(b"\0" + mark, mark))
        out.append((len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed=4):
    """Passages at every offset, inside each other, next to each other, hot."""
    rng = random.Random(seed)
    p = [prose(rng, rng.randint(20, 120)) for _ in range(5)]
    texts = []
    for i in range(120):
        part = []
        for _ in range(rng.randint(0, 3)):
            q = rng.choice(p)
            a = rng.randrange(0, 40)
            part += [prose(rng, rng.randint(0, 30)), q[a:len(q) - rng.randrange(0, 40)] if rng.random() < 0.5 else q]
        texts.append("ü".join([*part, prose(rng, rng.randint(0, 30)) + str(i)]))
    return texts


def check(spark, rows, docs):
    got = sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.removals(docs).collect())))
    want = sorted(map(repr, ((i, *x) for i, x in zip([r[0] for r in rows], brute([r[1] for r in rows])))))
    assert got == want


@pytest.mark.parametrize("group_rows", [2000, 2])
def test_removed_bytes(spark, monkeypatch, group_rows):
    monkeypatch.setattr(R, "GROUP_ROWS", group_rows)
    rows = list(enumerate(passages()))
    check(spark, rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))


def test_edge_rows(spark):
    check(spark, edge_rows(), edge_docs(spark))
    assert R.removals(empty_docs(spark)).count() == 0


def test_blocks_of_a_long_text(spark, monkeypatch):
    import numpy as np

    rng = random.Random(8)
    data = np.frombuffer(prose(rng, 3000).encode(), dtype=np.uint8)
    inside = np.ones(len(data), dtype=bool)
    whole = R.anchors(data, inside)
    monkeypatch.setattr(R, "BLOCK", 777)
    assert [x.tolist() for x in R.anchors(data, inside)] == [x.tolist() for x in whole]


def test_every_window_has_an_anchor_of_its_own_bytes():
    import numpy as np

    rng = random.Random(9)
    text = prose(rng, 400).encode()
    for a in range(0, len(text) - R.WINDOW, 37):
        w = np.frombuffer(text[a:a + R.WINDOW], dtype=np.uint8)
        at, _ = R.anchors(w, np.ones(len(w), dtype=bool))
        padded = np.frombuffer(b"x" * 50 + text[a:a + R.WINDOW] + b"y" * 50, dtype=np.uint8)
        one = np.zeros(len(padded), dtype=bool)
        one[50] = True
        # the whole window selects one place, wherever it stands
        assert [p - 50 for p in R.anchors(padded, one)[0].tolist()] == at.tolist()[:1] and len(at) == 1


@pytest.mark.parametrize("seed", range(60))
def test_interval_tree_covers_what_pairs_cover(seed):
    """Extensions from the tree equal those from all pairs of contexts."""
    rng = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abc"
    m = rng.randint(2, 12)
    core = bytes(rng.choice(letters) for _ in range(64))
    both = set()
    while len(both) < m:
        cut = rng.randint(100, 199)
        left = core * 2 + bytes([rng.choice(letters)]) if rng.random() < 0.5 else bytes(rng.choice(letters) for _ in range(136))
        both.add((left[:rng.randint(100, 136)], (core * 4)[:cut] + bytes(rng.choice(letters) for _ in range(200 - cut))))
    pairs = sorted(both, key=lambda x: x[1])
    left, right = [x for x, _ in pairs], [x for _, x in pairs]
    want = collections.defaultdict(lambda: (0, 0))
    for i in range(m):
        for j in range(m):
            if i != j:
                e, r = R.common_prefix(left[i], left[j]), R.common_prefix(right[i], right[j])
                if e + r >= R.WINDOW:
                    want[i] = max(want[i][0], e), max(want[i][1], r)
    got = collections.defaultdict(lambda: (0, 0))
    for e, r, members in R.maximal_repeats(left, right):
        assert len(members) > 1 and e + r >= R.WINDOW
        # all members share exactly this repeat
        assert len({left[i][:e] for i in members}) == 1 and len({right[i][:r] for i in members}) == 1
        # and it holds all contexts that share it
        assert sorted(i for i in range(m) if left[i][:e] == left[members[0]][:e] and right[i][:r] == right[members[0]][:r]
                      and len(left[i]) >= e and len(right[i]) >= r) == members
        for i in members:
            got[i] = max(got[i][0], e), max(got[i][1], r)
    assert dict(got) == dict(want)


def test_groups_hold_all_occurrences(spark):
    rng = random.Random(11)
    p = prose(rng, 50)
    rows = [(i, f"{prose(rng, 20)} {p} {prose(rng, 20)}") for i in range(5)]
    groups = collections.defaultdict(list)
    for r in R.Repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).groups().collect():
        text = dict(rows)[r.key].encode()
        groups[(r.h, r.nth)].append((r.key, text[r.start:r.start + r.length]))
    assert groups and all(len({t for _, t in g}) == 1 and len(next(iter(g))[1]) >= R.WINDOW for g in groups.values())
    assert max(len(g) for g in groups.values()) == 5


def test_groups_of_hot_anchors_are_whole(spark, monkeypatch):
    """More contexts than a chunk holds, and a longer repeat that only two of them share."""
    rng = random.Random(12)
    p, longer = prose(rng, 50), prose(rng, 8)
    rows = [(i, f"{prose(rng, 20)} {p} {longer if i in (0, 7) else ''} {prose(rng, 20)}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def groups():
        out = collections.defaultdict(set)
        for r in R.Repeats(docs).groups().collect():
            out[(r.h, r.nth)].add((r.key, r.start, r.length))
        return sorted(map(sorted, out.values()))

    want = groups()
    assert max(map(len, want)) == 12
    monkeypatch.setattr(R, "GROUP_ROWS", 2)
    assert groups() == want


def test_remove_keeps_rows_and_columns(spark):
    docs = edge_docs(spark)
    out = R.remove(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    rows = edge_rows()
    data = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(b[i:i + 200] for b in data for i in range(len(b) - 199))
    want = []
    for r, b in zip(rows, data):
        mark = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                mark[i:i + 200] = b"\1" * 200
        if any(mark):
            parts, at = [], None
            for i in range(len(b) + 1):
                if i < len(b) and not mark[i]:
                    at = i if at is None else at
                elif at is not None:
                    parts.append(b[at:i].decode("utf-8", "ignore"))
                    at = None
            text = "".join(parts)
            want.append((r[0], text, len(text)))
        else:
            want.append((r[0], r[1], r[4]))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.n_chars)) for r in out.collect())
    assert R.remove(empty_docs(spark)).count() == 0


def test_made_rows_are_not_broadcast(spark, monkeypatch):
    """Anchors, contexts and windows are many times the file they are made from;
    only counted id lists are broadcast."""
    from demoforge.llm.common import Workspace
    plans, save = [], Workspace.save

    def seen(self, df, tag="t"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, tag)

    monkeypatch.setattr(Workspace, "save", seen)
    monkeypatch.setattr(R, "GROUP_ROWS", 2)
    rng = random.Random(9)
    p = prose(rng, 80)
    docs = spark.createDataFrame([(i, prose(rng, 20) + p + prose(rng, 20)) for i in range(8)], "doc_id long, text string")
    R.Repeats(docs).spans()
    heavy = [x for x in plans if "Join" in x and "left_semi" not in x.lower() and "leftanti" not in x.lower() and "leftsemi" not in x.lower()]
    assert len(heavy) > 5 and not [x for x in heavy if "BroadcastHashJoin" in x]
