import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from demoforge.llm import langid, quality, toxicity
from tests.conftest import SF_CHECK
from tests.llm.edge import edge_docs, empty_docs


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_kneser_ney_ratio_by_hand(spark):
    """The Spark model against a literal recursive Kneser-Ney."""
    rows = [("abba cab abba", 0), ("cab cab dab", 1), ("bad abba", 1), ("cc", 0)] * 3
    from demoforge.llm.common import Workspace

    model = toxicity.fit_model(Workspace(spark, "test"), spark.createDataFrame(rows, "text string, y int"))
    grams = ({}, {})
    for t, y in rows:
        for w in t.split():
            s = "\x01" + w + "\x02"
            for i in range(1, len(s)):
                g = s[max(0, i - 5):i + 1]
                grams[y][g] = grams[y].get(g, 0) + 1
    tails = {g[k:] for y in (0, 1) for g in grams[y] for k in range(len(g))}

    def shared(t):
        c = [x for x in tails if len(x) == len(t) + 1 and x[1:] == t]
        ctx = {}
        for x in tails:
            if len(x) == len(t) + 1 and x[1:-1] == t[:-1]:
                ctx[x[1:]] = ctx.get(x[1:], 0) + 1
        back = shared(t[1:]) if len(t) > 1 else 1 / toxicity.ALPHABET
        n = sum(ctx.values())
        return max(len(c) - 0.75, 0) / n + 0.75 * len(ctx) / n * back if n else back

    def p(y, g):
        same = {x: c for x, c in grams[y].items() if x[:-1] == g[:-1]}
        n = sum(same.values())
        back = shared(g[1:])
        return max(same.get(g, 0) - 0.75, 0) / n + 0.75 * len(same) / n * back if n else back

    for w in ("abba", "cab", "bad", "dab", "cc", "abad", "zzz", "c"):
        s = "\x01" + w + "\x02"
        want = sum(math.log(p(1, g) / p(0, g)) for g in (s[max(0, i - 5):i + 1] for i in range(1, len(s))))
        assert model.features([w])[0][0] == pytest.approx(want, abs=1e-3), w


def auc(score, y):
    import pandas as pd

    r = pd.Series(score).rank().to_numpy()
    return (r[y].mean() - (y.sum() + 1) / 2) / (~y).sum()


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    rows = E.queries()["op3_toxicity"](spark, SF_CHECK).collect()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc([r.score for r in held], np.array([labels[r.doc_id] == 1 for r in held])) > 0.9


def test_ngrams_keep_their_own_ratio(spark):
    """Renaming letters changes no ratio, whatever the hashes of the names."""
    from demoforge.llm.chars import framed, gram_hashes
    from demoforge.llm.common import Workspace

    rng = np.random.RandomState(3)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklm"), (20_000, 9))]
    data, start = framed(words)
    # n-grams whose hashes agree in the bits that named their slot
    slot = (gram_hashes(data, start, 6)[start + 6] >> np.uint64(3)) % np.uint64(1 << 22)
    first, pair = {}, None
    for w, x in zip(words, slot.tolist()):
        if pair is None and first.setdefault(x, w)[:6] != w[:6]:
            pair = first[x], w
    rename = str.maketrans("abcdefghijklm", "nopqrstuvwxyz")

    def ratio(bad, good):
        rows = [(bad, 1), (" ".join([good] * 500), 0)]
        return toxicity.fit_model(Workspace(spark, "test"), spark.createDataFrame(rows, "text string, y int")).features([bad])[0][0]

    assert ratio(*pair) == pytest.approx(ratio(*(w.translate(rename) for w in pair)), abs=1e-3)


def test_toxicity_learns_from_every_fold(spark):
    """An insult whose labelled rows all lie in fold 1 is learned."""
    rng = np.random.RandomState(5)
    ids = {f: [i for i in range(1000) if fold(i, 5) == f] for f in range(5)}
    plain = [" ".join(rng.choice(["river", "stone", "garden", "window", "market"], 12)) for _ in range(1000)]
    insult = {f: "snarfwit" for f in (2, 3, 4)} | {1: "gribbleton"}
    rows = [(i, f"{plain[i]} {insult[f]}" if k % 2 else plain[i], k % 2) for f in insult for k, i in enumerate(ids[f][:60])]
    rows += [(i, f"{plain[i]} gribbleton" if k % 2 else plain[i], None) for k, i in enumerate(ids[0][:60])]
    # some of fold 1 carries the known insult, so that the curve has a slope
    rows = [(i, t.replace("gribbleton", "snarfwit") if fold(i, 5) == 1 and i % 3 == 0 else t, y) for i, t, y in rows]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    score = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    held = {y: [score[i] for i, t, _ in rows if fold(i, 5) == 0 and ("gribbleton" in t) == y] for y in (True, False)}
    assert min(held[True]) > max(held[False]) + 0.2


def test_toxicity_joined_tables(spark, monkeypatch):
    """A model too large to gather scores as a gathered one."""
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id bigint, toxic int")
    want, got = [], []
    for out, most in ((want, toxicity.GATHER), (got, 0)):
        monkeypatch.setattr(toxicity, "GATHER", most)
        out += sorted(((repr(r.doc_id), r.score) for r in toxicity.score(docs, labels).collect()))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-6)


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, None if i == 4 else int(i % 3 == 0)) for i in range(30)] + [(1, 0, 1), (None, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    for lab in (labels, labels.filter("toxic = 1"), labels.filter("toxic > 5")):
        rows = toxicity.score(docs, lab).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty_docs(spark), labels).count() == 0


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang").collect()}
    rows = E.queries()["op5_langid"](spark, SF_CHECK).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_mixture_finds_both_languages():
    rng = np.random.RandomState(0)
    # three languages; 70 words of the first, 30 of the second, none of the third
    p = np.full((100, 3), 0.01)
    p[:70, 0], p[70:, 1] = 1, 1
    p *= rng.uniform(0.5, 2, p.shape)
    share, _ = langid.Languages.mixture(p, np.ones(100))
    assert share == pytest.approx([0.7, 0.3, 0], abs=0.03)


def test_large_language_model_stays_a_table(spark, monkeypatch):
    """Scores of the joined tables equal those of the gathered model."""
    from demoforge.session import read_table

    docs = read_table(spark, "/root/testdata/sf0.001", "documents").repartition(3)
    both = docs.unionByName(edge_docs(spark).select(*docs.columns))
    want = {(r.doc_id, round(r.score, 9), r.lang_pred) for r in langid.identify(both).collect()}
    monkeypatch.setattr(langid, "GATHER", 0)
    assert {(r.doc_id, round(r.score, 9), r.lang_pred) for r in langid.identify(both).collect()} == want


def test_language_likelihoods_by_hand(spark):
    """Counts, smoothing and word likelihoods against a literal version; no two n-grams share a count."""
    from collections import Counter
    from math import log

    from demoforge.llm.common import Workspace

    rows = [("abba cab", "x"), ("cab dab ü", "y"), ("bad bad", "y"), ("c", "x")]
    ws = Workspace(spark, "test")
    model, _ = langid.Languages.of(ws, ws.save(langid._counts(spark.createDataFrame(rows, "text string, lang string")), "c"))
    framed = lambda w: "\x01" + w + "\x02"
    gram = lambda f, i, k: f[max(0, i - k + 1):i + 1]
    count = {(lang, k): Counter(gram(framed(w), i, k) for t, x in rows if x == lang for w in t.split() for i in range(len(w) + 2))
             for lang in "xy" for k in range(1, 5)}
    for w in ("abba", "zzz", "bü"):
        want = []
        for lang in "xy":
            total = 0.0
            for k in range(1, 5):
                kinds = len(set(count["x", k]) | set(count["y", k]))
                for i in range(len(w) + 2):
                    total += log((count[lang, k][gram(framed(w), i, k)] + 0.1) / (sum(count[lang, k].values()) + 0.1 * kinds))
            want.append(total / 4)
        assert model.words([w])[0] == pytest.approx([v - max(want) for v in want])


def literal_set(p, m):
    """EM and the penalised choice among nested sets, word by word."""
    from math import log

    def em(cols):
        share = [1 / len(cols)] * len(cols)
        for _ in range(20 if len(cols) > 1 else 0):
            new = [0.0] * len(cols)
            for row, n in zip(p, m):
                mix = [row[c] * s for c, s in zip(cols, share)]
                for j, v in enumerate(mix):
                    new[j] += n * v / sum(mix) / sum(m)
            done = max(abs(a - b) for a, b in zip(new, share)) < 1e-4
            share = new
            if done:
                break
        return share, sum(n * log(sum(row[c] * s for c, s in zip(cols, share))) for row, n in zip(p, m))

    everything, _ = em(list(range(len(p[0]))))
    order = sorted(range(len(p[0])), key=lambda c: -everything[c])
    best = None
    for k in range(1, len(order) + 1):
        share, fit = em(order[:k])
        value = fit - 0.5 * (k - 1) * log(max(sum(m), 2))
        if best is not None and value <= best[0]:
            break
        best = (value, share, order[:k])
    return max(zip(best[1], [-c for c in best[2]]))


@pytest.mark.parametrize("seed", range(6))
def test_language_set_by_hand(seed):
    rng = np.random.RandomState(seed)
    p = rng.uniform(0.01, 1, (rng.randint(2, 30), 4)) * (rng.rand(4) < 0.6) + 0.003
    p /= p.max(axis=1, keepdims=True)
    m = rng.randint(1, 5, len(p))
    (name, score), = langid.Languages(list("abcd"), np.zeros((4, 4))).decide([np.repeat(np.arange(len(p)), m)], np.log(p))
    share, column = literal_set(p.tolist(), m.tolist())
    assert score == pytest.approx(share) and name == "abcd"[-column]


def test_language_edges(spark):
    docs = edge_docs(spark)
    by_text = {}
    for r in langid.identify(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "und")
        by_text[r.text] = r.lang_pred
    assert by_text[""] == by_text["1234567890" * 30] == "und"
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.identify(empty_docs(spark)).count() == 0


def test_ordinal_grades():
    """Five grades from a hidden score: ordered thresholds, useful expectation."""
    rng = np.random.RandomState(0)
    words = [f"w{i}" for i in range(50)]
    value = rng.randn(50) * 2
    texts, grades = [], []
    for _ in range(1500):
        at = rng.randint(0, 50, rng.randint(5, 40))
        texts.append(" ".join(words[i] for i in at))
        grades.append(float(np.digitize(value[at].mean() + 0.05 * rng.randn(), [-0.6, -0.2, 0.2, 0.6])))
    slots = [tuple(np.unique(s, return_counts=True)) for s in quality.feature_slots(texts)]
    m = quality.Ordinal.fit([(a, n.astype(float)) for a, n in slots[:1200]], [len(t.split()) for t in texts[:1200]], grades[:1200])
    assert (np.diff(m.thresholds) > 0).all() and m.grades == [0, 1, 2, 3, 4]
    p = m.above(texts[1200:])
    assert (np.diff(p, axis=1) <= 0).all()
    assert np.corrcoef(p.sum(axis=1), grades[1200:])[0, 1] > 0.9


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    rows = [r for r in E.queries()["op7_ordinal_quality"](spark, SF_CHECK).collect()]
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.kept == (labels[r.doc_id] == 1) for r in held]) > 0.97


def test_quality_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, None if i == 4 else i % 3) for i in range(30)] + [(1, 2), (None, 1)], "doc_id bigint, quality int")
    out = quality.select_quality(docs, labels)
    assert out.columns == docs.columns
    for lab in (labels, labels.filter("quality = 0"), labels.filter("quality > 5")):
        rows = quality.assess(docs, lab).collect()
        assert len(rows) == docs.count()
    assert all(r.kept for r in quality.assess(docs, labels.filter("quality > 5")).collect())
    assert quality.assess(empty_docs(spark), labels).count() == 0
