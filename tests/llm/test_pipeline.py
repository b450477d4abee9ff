import collections

import pytest

import __spark_entry__ as E
import corpus_pipeline as C
from demoforge.llm.common import Workspace
from tests.conftest import SF_SMALL
from tests.llm.edge import edge_docs
from tests.llm.test_duplicates import brute_components, lowered, spec_fingerprint
from tests.llm.test_suffix_repeats import brute


@pytest.fixture(scope="module")
def written(spark):
    """Each stage's input and output on the driver's smallest tables."""
    ws = Workspace(spark, "test-pipeline")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(ws.save(stage(spark, out[-1], SF_SMALL), name))
    return out


def test_stages_and_registration():
    assert [n for n, _ in C.STAGES] == ["quality", "exact_dedup", "simhash_near_dedup", "suffix_dedup", "packing"]
    assert E.queries()["pipeline"] is C.run and "pipeline" not in E.oracle_sql()
    assert all(any(q.startswith(f"op{n}_") for q in E.queries()) for n in range(1, 11))


def test_columns(written):
    assert all(df.columns == written[0].columns for df in written[:-1])


def test_quality_keeps_clean_documents(spark, written):
    kept = {r.doc_id for r in written[1].collect()}
    for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect():
        if r.quality == 1:
            assert r.doc_id in kept


def test_exact(written):
    groups = collections.defaultdict(list)
    for r in written[1].collect():
        groups[lowered(r.text)].append(r.doc_id)
    assert {max(g) for g in groups.values()} == {r.doc_id for r in written[2].collect()}


def test_near(written):
    rows = written[2].collect()
    comp = brute_components([r.doc_id for r in rows], [spec_fingerprint(r.text) for r in rows])
    assert set(comp) == {r.doc_id for r in written[3].collect()}


def test_passages(written):
    before, after = written[3].collect(), {r.doc_id: r for r in written[4].collect()}
    assert len(before) == len(after)
    for r, (n, removed, _, _) in zip(before, brute([r.text for r in before])):
        a = after[r.doc_id]
        # a cut character may go whole
        assert n - removed - 6 <= len(a.text.encode()) <= n - removed
        assert a.text == r.text if not removed else a.n_chars == len(a.text)


def test_packing(written):
    ids = {r.doc_id for r in written[4].collect()}
    rows = written[5].collect()
    assert {r.doc_id for r in rows} == ids
    used = collections.Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_run_equals_the_stages(spark, written):
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in C.run(spark, SF_SMALL).collect())
    assert got == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in written[5].collect())


def test_every_stage_takes_odd_rows(spark):
    docs = edge_docs(spark)
    ws = Workspace(spark, "test-pipeline")
    for name, stage in C.STAGES:
        out = ws.save(stage(spark, docs, SF_SMALL), name)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert docs.count() > 0
