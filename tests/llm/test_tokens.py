import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from demoforge.llm import bpe_trie, token_files
from demoforge.llm.common import Workspace
from demoforge.llm.encode import default_tokenizer, library_encoder
from tests.llm.edge import edge_docs, edge_rows, empty_docs


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def fuzz_texts(n=3000, seed=1):
    rng = random.Random(seed)
    pool = [*"aab  \n\t'sxt1²ééß  .,!中の\x1c\x85\xa0 ​", "<|endoftext|>", "the", " the", "'ll", "\n\n", "  ", "aaaa", "     ", " 's"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_trie_and_memo_equal_the_library(library):
    texts = fuzz_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    bpe, memo, _ = bpe_trie.loaded(default_tokenizer())
    for encoder in (memo, library_encoder(default_tokenizer())):
        for _ in range(2):  # the second time from the memo
            assert [np.frombuffer(b, "<u4").tolist() for b in encoder.batch(texts)] == want
    assert all(bpe.decode(ids) == library.decode(ids, skip_special_tokens=False) for ids in want)


def test_memo_restarts_without_changing_results(library, monkeypatch):
    from demoforge.llm import encode

    monkeypatch.setattr(encode, "MEMO_WORDS", 50)
    bpe = bpe_trie.TrieBPE(default_tokenizer())
    memo = encode.WordMemo(lambda words, texts: bpe.encode([" " + w for w in words] + texts), ("<|endoftext|>",))
    texts = fuzz_texts(600, 2)
    for a in range(0, 600, 60):
        want = [e.ids for e in library.encode_batch(texts[a:a + 60], add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in memo.batch(texts[a:a + 60])] == want


def test_decode_of_cut_characters(library):
    bpe, _, _ = bpe_trie.loaded(default_tokenizer())
    ids = library.encode("中文 ééé 🙂", add_special_tokens=False).ids
    for k in range(len(ids)):
        assert bpe.decode(ids[:k]) == library.decode(ids[:k], skip_special_tokens=False)


def test_encode_documents(spark, library):
    rows = bpe_trie.encode_documents(edge_docs(spark), default_tokenizer()).collect()
    want = []
    for r in edge_rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in rows)
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert bpe_trie.encode_documents(empty_docs(spark), default_tokenizer(), False).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_elias_fano(seed):
    rng = np.random.RandomState(seed)
    n = rng.randint(0, 3000)
    v = np.sort(rng.randint(0, [10, 5000, 1 << 40, 1 << 62][seed % 4], n))
    ef, end = token_files.EliasFano.read(token_files.EliasFano.of(v).to_bytes() + b"rest", 0)
    assert ef.values().tolist() == v.tolist()
    for i in rng.randint(0, max(n, 1), 50) if n else []:
        assert ef.select(int(i)) == v[i]
    with pytest.raises(IndexError):
        ef.select(n)


def test_elias_fano_is_small():
    v = np.cumsum(np.random.RandomState(0).randint(1, 2000, 10_000))
    assert len(token_files.EliasFano.of(v).to_bytes()) < 10_000 * 1.7  # a 64-bit table takes 80,000


def test_token_files_round_trip(spark, library, monkeypatch):
    ws = Workspace(spark, "test-files")
    path = ws.path()
    token_files.write_token_files(edge_docs(spark), path, default_tokenizer())
    rows = token_files.read_token_files(spark, path).collect()
    want = sorted(((r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in edge_rows()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(rows) == len(want)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    digest = lambda i, ids: (i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    assert sorted(map(repr, (digest(*x) for x in want))) == sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in rows)
    assert [x[0] for x in want] == [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    # random access through select
    for image, in spark.read.parquet(path).select("image").collect():
        s = token_files.Segment(bytes(image))
        for k in range(len(s)):
            d = s.doc_id(k)
            assert any(x[0] == d and x[1] == s.document(k).tolist() for x in want)


def test_token_files_of_nothing(spark):
    path = Workspace(spark, "test-files").path()
    token_files.write_token_files(empty_docs(spark), path, default_tokenizer())
    assert token_files.read_token_files(spark, path).count() == 0


def test_words_at_line_ends_are_remembered(library):
    """Texts are cut before their line ends: what stands on both sides of one is
    no word of its own that is encoded anew for every pair."""
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(30)] + ["'s", "été.", "--", "12"]
    sep = [" ", " ", "\n", "\n\n", "\r\n", " \n", "\n ", "\t", "\n\t"]
    plain = ["\n".join(rng.choice(words) for _ in range(200)) for _ in range(40)]
    mixed = ["".join(rng.choice(words) + rng.choice(sep) for _ in range(20)) for _ in range(400)]
    texts = [*plain, *mixed, "\n", "\nab\n", "ab\n", "a\n<|endoftext|>\nb"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for encoder in (library_encoder(default_tokenizer()), bpe_trie.loaded(default_tokenizer())[1]):
        asked = []
        compute = encoder.words.compute
        encoder.words.compute = lambda many, compute=compute, asked=asked: asked.extend(many) or compute(many)
        try:
            assert [np.frombuffer(b, "<u4").tolist() for b in encoder.batch(texts[:40])] == want[:40]
            assert len(asked) <= len(words)
            assert [np.frombuffer(b, "<u4").tolist() for b in encoder.batch(texts)] == want
        finally:
            encoder.words.compute = compute


def test_array_memo_is_bounded(monkeypatch):
    import pyarrow as pa

    from demoforge.llm import encode

    monkeypatch.setattr(encode, "MEMO_WORDS", 20)
    memo = encode.ArrayMemo(lambda many: [np.array([ord(c) for c in w], dtype="<u4").tobytes() for w in many])
    rng = random.Random(6)
    for _ in range(60):
        words = list({"".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 4, 70]))) for _ in range(15)})
        flat, starts, sizes = memo.of(pa.array(words, pa.string()))
        assert ["".join(map(chr, flat[a:a + n])) for a, n in zip(starts, sizes)] == words
        assert len(memo.keys) <= encode.ARRAY_MEMO * 20 + 15 and len(memo.flat) <= 4 * len(memo.keys)
    flat, starts, _ = memo.of(pa.array([], pa.string()))
    assert len(starts) == 0
