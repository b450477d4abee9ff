"""Minimum edit distance by segments against all pairs."""

import random

import pytest

from demoforge.operators import concepts as CN


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(texts):
    texts = sorted(set(t for t in texts if t is not None))
    return {a: min((levenshtein(a, b) for b in texts if b != a), default=None) for a in texts}


def got(spark, texts, **kw):
    df = spark.createDataFrame([(t,) for t in texts], "concept string").repartition(3)
    return {r.concept: r.min_dist for r in CN.min_edit_distance(df, **kw).collect()}


def made(seed, n, alphabet, size):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n // 2)]
    out = list(base)
    for t in base:
        t = list(t)
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(t))
            rng.choice([lambda: t.insert(k, rng.choice(alphabet)), lambda: t.pop(k) if k < len(t) else None,
                        lambda: t.__setitem__(k, rng.choice(alphabet)) if k < len(t) else None])()
        out.append("".join(t))
    return out


@pytest.mark.parametrize("seed, alphabet, size", [(1, "ab", 14), (2, "abcdefgh ", 40), (3, "aé🙂中", 20)])
def test_equals_all_pairs(spark, seed, alphabet, size):
    texts = made(seed, 160, alphabet, size) + [None, "", alphabet * 9]
    assert got(spark, texts) == nearest(texts)


def test_segment_rounds_alone(spark, monkeypatch):
    """Every round through segments, whatever the number of concepts, and every round through bands."""
    texts = made(4, 60, "abc ", 25) + ["x" * 70, "y" * 3]
    for way in (0, 10 ** 9):
        monkeypatch.setattr(CN, "probes_of", lambda d, way=way: way)
        assert got(spark, texts, start=1) == nearest(texts)


def test_few_concepts(spark):
    assert got(spark, []) == {} and got(spark, [None]) == {}
    assert got(spark, ["only"]) == {"only": None}
    assert got(spark, ["", "abc"]) == {"": 3, "abc": 3}


def test_compared_pairs_stay_far_below_all(spark):
    """Random texts with one near copy each: pairs that share no segment are never compared."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(30, 60))) for _ in range(1500)]
    texts = base + [t[:10] + "#" + t[11:] for t in base]
    report = []
    rows = got(spark, texts, report=report)
    assert set(rows.values()) == {1}
    n = len(texts)
    assert sum(r["compared"] for r in report) < n * n / 100, report


def test_concepts_are_read_once(spark):
    from pyspark.sql import functions as F
    from demoforge.operators import concepts as CN
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.range(50, numPartitions=2).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("concept"))
    out = CN.concept_split(df.mapInArrow(seen, "concept string"), (1,), 5)
    assert out.count() == 50
    assert read.value == 50


def test_what_a_round_makes_of_texts_is_not_broadcast(spark, monkeypatch):
    """Their file is small, the exploded rows need not be."""
    plans, written = [], CN.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(CN, "cut_lineage", seen)
    monkeypatch.setattr(CN, "BROADCAST_BYTES", 1000, raising=False)
    texts = ["view " * 4 + "".join(2 * c for c in f"{i:02d}") for i in range(40)]
    for way in (0, 10 ** 9):
        plans.clear()
        monkeypatch.setattr(CN, "probes_of", lambda d, way=way: way)
        assert set(got(spark, texts).values()) == {2}
        assert any("Join" in p for p in plans) and not [p for p in plans if "BroadcastHashJoin" in p]


def test_split_and_dataset_joins_are_not_broadcast(spark):
    df = spark.createDataFrame([(f"c{i}",) for i in range(50)], "concept string")
    plan = CN.concept_split(df, (1,), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan


@pytest.mark.parametrize("d", [1, 4, 5, 16])
def test_probes_of(d):
    assert CN.probes_of(d) == sum(min(i, s + d - i) - max(-i, s - (d - i)) + 1 for s in range(-d, d + 1) for i in range(d + 1))


@pytest.mark.parametrize("small", [0, 1 << 40])
@pytest.mark.parametrize("way", [0, 10 ** 9])
def test_joins_by_size_give_the_same(spark, monkeypatch, small, way):
    """Broadcast or not, by segments or in a grid of cells."""
    monkeypatch.setattr(CN, "BROADCAST_BYTES", small)
    monkeypatch.setattr(CN, "CELL_BYTES", 2000)
    monkeypatch.setattr(CN, "probes_of", lambda d: way)
    texts = made(6, 60, "ab ", 25) + ["", "x" * 60]
    assert got(spark, texts, start=2) == nearest(texts)
