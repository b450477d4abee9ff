"""Cross-tokenizer alignment against a literal version."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from demoforge.llm import alignment
from demoforge.llm.encode import byte_letters, default_tokenizer
from tests.llm.edge import edge_docs, edge_rows, empty_docs
from tests.llm.test_tokens import fuzz_texts

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Literal:
    def __init__(self):
        self.a = Tokenizer.from_file(default_tokenizer())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
        self.letters = byte_letters()

    def tokens(self, text):
        """[(id, start, end)] of both sides, or nothing."""
        if not text:
            return [], []
        sides = []
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        sides.append([(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in ids])
        side = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            side.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        sides.append(side)
        if any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
            return [], []
        out = []
        for s in sides:
            at, rows = 0, []
            for i, raw in s:
                rows.append((i, at, at + len(raw)))
                at += len(raw)
            out.append(rows)
        return tuple(out)

    def rows(self, docs):
        known, total = [], Counter()
        for d, text in docs:
            a, b = self.tokens(text)
            links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 3000 else list(self.sweep(a, b))
            total.update(links)
            known.append((d, a, b, links))
        top = Counter()
        for (_, y), n in total.items():
            top[y] = max(top[y], n)
        out = []
        for d, a, b, links in known:
            ends = sorted({x[2] for x in a} & {x[2] for x in b})
            text, i, j = [], 0, 0
            for e in ends:
                ga, gb = [], []
                while i < len(a) and a[i][2] <= e:
                    ga.append(str(a[i][0]))
                    i += 1
                while j < len(b) and b[j][2] <= e:
                    gb.append(str(b[j][0]))
                    j += 1
                text.append(",".join(ga) + "|" + ",".join(gb))
            sha = hashlib.sha256(";".join(text).encode()).hexdigest() if a else ""
            out.append((d, len(a), len(b), len(ends), len(links), sum(total[x] == top[x[1]] for x in links), sum(total[x] for x in links), sha))
        return out

    @staticmethod
    def sweep(a, b):
        i = j = 0
        while i < len(a) and j < len(b):
            yield a[i][0], b[j][0]
            if a[i][2] == b[j][2]:
                i, j = i + 1, j + 1
            elif a[i][2] < b[j][2]:
                i += 1
            else:
                j += 1


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def literal():
    return Literal()


def align(docs):
    return alignment.align(docs, default_tokenizer(), alignment.default_pieces())


def test_edge_rows(spark, literal):
    got = align(edge_docs(spark))
    assert got.columns == COLUMNS
    assert plain(got.collect()) == plain(literal.rows([(r[0], r[1]) for r in edge_rows()]))


ODD = ["a▁b c", " lead", "trail ", "  two", "x  y", "<s> </s> <|endoftext|> <0x41>", "tab\tx \n\n y", "\x00 nul", "ﬁ x", "a　b", "ｆｕｌｌ"]


def test_fuzzed_texts_and_blocks(spark, literal, monkeypatch):
    texts = ODD + fuzz_texts(600, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = plain(literal.rows(list(enumerate(texts))))
    assert plain(align(docs).collect()) == want


def test_many_blocks_give_the_same_counts(literal):
    """Counts do not depend on how documents are dealt into blocks: one block a document."""
    texts = fuzz_texts(40, 9)
    sides = alignment.Sides(default_tokenizer(), alignment.default_pieces())
    together = sides.encode(texts_column(texts))
    alone = [sides.encode(texts_column([t])) for t in texts]
    assert list(zip(*together)) == [(a[0], b[0]) for a, b in alone]
    assert [len(np.frombuffer(x, "<u4")) for x in together[0]] == [len(literal.tokens(t)[0]) for t in texts]


def texts_column(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())


def test_empty_table(spark):
    got = align(empty_docs(spark))
    assert got.columns == COLUMNS and got.count() == 0


def test_query_on_the_small_table(spark, literal):
    from demoforge.llm import queries
    from demoforge.session import read_table

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    assert plain(queries.QUERIES["op11_token_alignment"](spark, sf).collect()) == plain(literal.rows(docs))
