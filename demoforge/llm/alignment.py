"""Alignment of two tokenizers' tokens over the same bytes.

Side A is a byte-level BPE read by the tokenizers library, side B a sentencepiece
model.  A piece of documents is encoded by both, and ``pandas.merge_asof``, keyed
by document, finds for each token start the token of the other side that covers
it.  The union of both directions are all overlapping pairs; starts that meet
(that is, ends that meet) cut the tokens into groups.

How often an id pair is linked in the whole corpus is counted block by block: a
block (a piece of a task's rows) sends each of its different pairs once, with its
number of links, so a pair that stands in every document costs a row a block.
Counts come back to the block by the same key, where every document adds up those
of its links; links are never joined as rows.

Both encoders work on different words of a piece (see ``encode``): a word with
the space before it is a unit of both tokenizers, since no piece of B's
vocabulary has a space after another character (checked; otherwise whole texts
are encoded).  Where a unit's bytes differ from its text, the whole document is
encoded again and its bytes compared, as the rule says.

Nulls: a null or empty text has no tokens, nor has a text whose tokens' bytes
differ from it.  Texts are encoded whole; the longest document bounds a task's
memory.  Repeated rows count as often as they occur.  Ties: all pairs with the
highest count of a B id are best.  An empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoforge.llm.caches import held
from demoforge.llm.common import Workspace
from demoforge.llm.encode import Cut, Memo, byte_letters, library_encoder, slices

#: stands for the ids of a unit whose bytes differ from its text
BAD = b"\xff\xff\xff\xff"
#: links between documents' texts and counts: a column of these code types
_CODE = "<u4"

#: bytes of text in a block; its tokens and links are a worker's arrays
BLOCK_BYTES = 1_500_000

#: units in each of the memo's two generations
UNITS = 150_000

_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
_PAIR = "code int, a int, b int, n long"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Sides:
    """Both tokenizers of a worker, with the bytes of every token."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = library_encoder(a_path, plain=True)
        t = Tokenizer.from_file(a_path)
        letters = byte_letters()
        vocab = t.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            known = all(c in letters for c in entry)
            self.a_bytes[i] = bytes(letters[c] for c in entry) if known else entry.encode()
        self.b = s = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [s.id_to_piece(i) for i in range(s.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.a_bytes, self.b_bytes))
        self.units = Memo(lambda units: list(zip(self._a_units(units), self._b_units(units))), UNITS)

    def _checked(self, ids, known: list[bytes], want: bytes) -> bytes:
        return ids if b"".join([known[i] for i in np.frombuffer(ids, "<u4").tolist()]) == want else BAD

    def _a_units(self, units: list[str]) -> list[bytes]:
        ids = self.a.heads.compute(units)
        return [self._checked(x, self.a_bytes, u.encode()) for x, u in zip(ids, units)]

    def _b_units(self, units: list[str]) -> list[bytes]:
        """Units begin with the space that B adds."""
        ids = self.b.encode([u[1:] for u in units], num_threads=1)
        return [self._checked(np.array(x, dtype="<u4").tobytes(), self.b_bytes, u.encode()) for x, u in zip(ids, units)]

    def encode(self, column) -> tuple[list[bytes], list[bytes]]:
        """Of every text: the ids of both sides as unsigned 32-bit bytes, none
        where there are no tokens by the rule."""
        import pyarrow as pa
        import pyarrow.compute as pc

        col = pc.fill_null(column, "")
        empty = np.asarray(pc.equal(pc.binary_length(col), 0))
        spaced = pc.binary_join_element_wise(" ", col, "")
        if self.cuts:
            cut = Cut(spaced)
            units, heads, index, b = [" " + w for w in cut.words], cut.heads, cut.index.tolist(), cut.bounds.tolist()
        else:
            units, heads, index, b = [], spaced.to_pylist(), [], [0] * (len(col) + 1)
        found = list({h for h in heads if h})
        both, firsts = self.units.of(units), dict(zip(found, self.units.of(found))) | {"": (b"", b"")}
        sides = []
        for side, whole in enumerate((self._a_units, self._b_units)):
            words = [w[side] for w in both]
            many = list(map(words.__getitem__, index))
            ids = [firsts[h][side] + b"".join(many[x:y]) for h, x, y in zip(heads, b, b[1:])]
            bad = {i for i, w in enumerate(words) if w == BAD}
            for k, (h, x, y) in enumerate(zip(heads, b, b[1:])):
                if empty[k]:
                    ids[k] = b""
                elif firsts[h][side] == BAD or (bad and not bad.isdisjoint(index[x:y])):
                    ids[k] = whole([spaced[k].as_py()])[0]  # BAD again, or the whole text's ids
            sides.append(ids)
        none = [k for k, (x, y) in enumerate(zip(*sides)) if BAD in (x, y)]
        for k in none:
            sides[0][k] = sides[1][k] = b""
        return tuple(sides)


def covering(a_doc, a_start, b_doc, b_start):
    """All overlapping pairs (token of A, token of B) of tilings of the same
    bytes, and which starts of A and of B meet."""
    import pandas as pd

    a = pd.DataFrame({"doc": a_doc, "at": a_start, "i": np.arange(len(a_start))})
    b = pd.DataFrame({"doc": b_doc, "at": b_start, "j": np.arange(len(b_start))})
    onto_b = pd.merge_asof(a, b, on="at", by="doc")
    onto_a = pd.merge_asof(b, a, on="at", by="doc")
    onto_b["j"], onto_a["i"] = onto_b["j"].astype(np.int64), onto_a["i"].astype(np.int64)
    a_meets = b_start[onto_b["j"].to_numpy()] == a_start
    b_meets = a_start[onto_a["i"].to_numpy()] == b_start
    # a meeting pair is found from both sides
    back = onto_a[~b_meets]
    return (onto_b["i"].to_numpy(), onto_b["j"].to_numpy()), (back["i"].to_numpy(), back["j"].to_numpy()), a_meets, b_meets


def group_texts(a_ids, b_ids, a_meets, b_meets, doc_a, doc_b) -> list[bytes]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``; doc_a and doc_b are the
    documents' bounds in the token arrays."""
    if not len(a_ids):
        return [b""] * (len(doc_a) - 1)
    a_first = np.append(np.flatnonzero(a_meets), len(a_ids))
    b_first = np.append(np.flatnonzero(b_meets), len(b_ids))
    ga, gb = np.cumsum(a_meets) - 1, np.cumsum(b_meets) - 1
    ids = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
    end = np.empty(len(ids), dtype=np.uint8)
    at_a, at_b = np.arange(len(a_ids)) + b_first[ga], np.arange(len(b_ids)) + a_first[gb + 1]
    ids[at_a], ids[at_b] = a_ids, b_ids
    comma, bar, semicolon = b",|;"
    end[at_a] = np.where(np.append(a_meets[1:], True), bar, comma)
    end[at_b] = np.where(np.append(b_meets[1:], True), semicolon, comma)
    digits = np.ones(len(ids), dtype=np.int64)
    most = 10
    while most <= ids.max(initial=0):
        digits += ids >= most
        most *= 10
    stop = np.cumsum(digits + 1)
    out = np.empty(int(stop[-1]) if len(stop) else 0, dtype=np.uint8)
    out[stop - 1] = end
    rest, at = ids, stop - 2
    while len(rest):
        out[at] = rest % 10 + 48
        more = rest >= 10
        rest, at = rest[more] // 10, at[more] - 1
    edge = np.append(0, stop)[doc_a + doc_b].tolist()
    raw = out.tobytes()
    return [raw[x:max(x, y - 1)] for x, y in zip(edge, edge[1:])]


def _aligned(a_path: str, b_path: str):
    """Batches of (doc_id, text) -> rows of documents and rows of a block's pairs."""

    def run(batches):
        import pandas as pd
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        names, types = zip(*[(c.split()[0], kinds[c.split()[1]]) for c in f"{_DOCUMENT}, {_PAIR}".split(", ")])

        def rows(block, cols):
            n = len(next(iter(cols.values())))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block))] + [pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(names, types)],
                names=["block", *names])

        sides = held(("align", a_path, b_path), lambda: Sides(a_path, b_path))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, BLOCK_BYTES):
                a, b = sides.encode(piece.column("text"))
                n_a, n_b = (np.array([len(x) // 4 for x in y], dtype=np.int64) for y in (a, b))
                a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a, b))
                doc_a, doc_b = (np.append(0, np.cumsum(n)) for n in (n_a, n_b))
                docs = np.arange(len(n_a))
                a_start, b_start = (np.cumsum(s[i]) - s[i] for s, i in ((sides.a_size, a), (sides.b_size, b)))
                fore, back, a_meets, b_meets = covering(np.repeat(docs, n_a), a_start, np.repeat(docs, n_b), b_start)
                texts = group_texts(a, b, a_meets, b_meets, doc_a, doc_b)
                n_groups = np.diff(np.append(0, np.cumsum(a_meets))[doc_a])
                pairs = np.concatenate([a[i] << 32 | b[j] for i, j in (fore, back)])
                code, known = pd.factorize(pairs)
                code = code.astype(_CODE)
                # links found from A stand at A's places, those found from B only behind them
                behind = len(a) + np.append(0, np.cumsum(~b_meets))[doc_b]
                links = [code[w:x].tobytes() + code[y:z].tobytes() for w, x, y, z in zip(
                    doc_a[:-1].tolist(), doc_a[1:].tolist(), behind[:-1].tolist(), behind[1:].tolist())]
                yield rows(block, {
                    "doc_id": piece.column("doc_id"), "n_a": n_a, "n_b": n_b, "n_groups": n_groups,
                    "n_links": n_a + n_b - n_groups,
                    "groups_sha256": [hashlib.sha256(t).hexdigest() if t else "" for t in texts], "links": links})
                step = 50_000
                n = np.bincount(code, minlength=len(known))
                for x in range(0, len(known), step):
                    own = known[x:x + step]
                    yield rows(block, {"code": np.arange(x, x + len(own)), "a": own >> 32, "b": own & 0xFFFFFFFF, "n": n[x:x + step]})
                block += 1

    return run


def _added(key, documents, counts):
    """A block's documents with the counts of their links added up."""
    import pandas as pd

    total, best = np.zeros((2, len(counts)), dtype=np.int64)
    at = counts["code"].to_numpy()
    total[at], best[at] = counts["total"].to_numpy(), counts["best"].to_numpy()
    codes = [np.frombuffer(x, _CODE) for x in documents["links"]]
    return pd.DataFrame({
        **{c: documents[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
        "n_best": [int(best[c].sum()) for c in codes], "count_sum": [int(total[c].sum()) for c in codes],
        "groups_sha256": documents["groups_sha256"]})


class Alignment:
    """The aligned corpus: ``table`` in the shared folder, ``pairs`` (a, b,
    total, best: whether no other A id is linked more often with b)."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str):
        self.ws = ws = Workspace(docs.sparkSession, "alignment")
        path = ws.path("aligned")
        schema = f"block long, {_DOCUMENT}, {_PAIR}"
        (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
         .mapInArrow(_aligned(a_path, b_path), schema).write.option("compression", "zstd").parquet(path))
        self.table = docs.sparkSession.read.schema(schema).parquet(path)
        self.blocks = self.table.filter("code IS NOT NULL").select("block", "code", "a", "b", "n")
        counts = ws.save(self.blocks.groupBy("a", "b").agg(F.sum("n").alias("total")), "counts")
        top = counts.groupBy("b").agg(F.max("total").alias("top"))
        self.pairs = ws.save(counts.join(top, "b").select("a", "b", "total", (F.col("total") == F.col("top")).alias("best")), "pairs")

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
        counts = self.blocks.join(self.pairs, ["a", "b"]).select(F.col("block").alias("of"), "code", "total", "best")
        docs = self.table.filter("links IS NOT NULL").drop("code", "a", "b", "n")
        return docs.groupBy("block").cogroup(counts.groupBy("of")).applyInPandas(
            _added, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return Alignment(docs, a_path, b_path).documents()
