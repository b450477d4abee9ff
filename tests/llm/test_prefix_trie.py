"""The conversation trie against a literal version."""

import hashlib
import random
import zlib

import pytest

from demoforge.llm import prefix_trie

SCHEMA = "conv_id bigint, turn int, role string, text string, name string, node string, depth string, key string"


def nodes_of(paths):
    """paths: {conv: [(role, text)]} -> rows as the operator gives them."""
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members} if len(members) < 400 else None
    if kids is None:
        kids = {p: [] for p in members}
        for q in members:
            if q:
                kids[q[:-1]].append(q)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in kids[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, digest(r or "", x or ""), (r or "", x or "")))
    return {c: [x[3] for x in sorted(v)] for c, v in convs.items()}


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def rebuilt(rows):
    convs = ordered(rows)
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else -((-c) - (-c) % 100)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def made(seed, n=60, deep=9):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([*range(0, 40), *range(100, 130), *range(505, 520), -7, -150, 10 ** 12 + 3])
        if any(r[0] == c for r in rows):
            continue
        for t in range(rng.randint(1, deep)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "hé", "same long text", None, ""]), *["clash"] * 4))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("seed, n, deep", [(1, 60, 9), (2, 90, 3), (3, 20, 40)])
def test_random_conversations(spark, seed, n, deep):
    rows = made(seed, n, deep)
    assert plain(prefix_trie.rebuilt_trie(frame(spark, rows)).collect()) == plain(nodes_of(rebuilt(rows)))
    if seed == 1:
        assert plain(prefix_trie.conversation_trie(frame(spark, rows)).collect()) == plain(nodes_of(ordered(rows)))


def test_nulls_ties_and_repeats(spark):
    k = ["x"] * 4
    rows = [(5, None, None, None, *k), (5, 0, "user", "hi", *k), (5, 0, "user", "hi", *k), (5, 0, "user", "ho", *k), (None, 1, "user", "lost", *k),
            (6, None, "", "", *k), (6, 0, "user", "hi", *k), (7, 3, "user", "long " * 20_000, *k), (8, 3, "user", "long " * 20_000, *k)]
    assert plain(prefix_trie.conversation_trie(frame(spark, rows)).collect()) == plain(nodes_of(ordered(rows)))


def test_one_node_with_many_members_and_a_long_conversation(spark):
    """More member ids than a chunk holds; a conversation much longer than the others."""
    k = ["x"] * 4
    rows = [(c, 0, "user", "hello", *k) for c in range(10_000, 19_000)] + [(3, t, "user", f"t{t % 5}", *k) for t in range(300)]
    assert plain(prefix_trie.conversation_trie(frame(spark, rows)).collect()) == plain(nodes_of(ordered(rows)))


def test_empty_table(spark):
    got = prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.count() == 0
