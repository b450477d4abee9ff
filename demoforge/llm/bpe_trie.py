"""Byte-pair encoding by depth-first traversal of a word trie, and decoding.

The last token of a prefix's encoding decides the encoding: a prefix of length
i ends in token t exactly if t is a suffix of it, and t stays apart from the
last token of the prefix before t when the two are merged alone.  So the
different words of a batch are the leaves of a trie.  In sorted order they are
visited depth first, with the path to the present word on a stack: every prefix
carries its last token and the state of an automaton of all tokens, whose ends
are the tokens that end there, so a shared prefix is worked out once.

Two tokens stay apart if no merge across their border comes before the merges
that build them.  The walk over the two edges (``_apart``) compares ranks: the
left token's right edge and the right token's left edge grow towards the whole
tokens, and a cross merge wins when its rank is below the next inner one.

Nulls: a null text is the empty text, which has no ids.  Repeated rows give
repeated rows; an empty table gives an empty one; other columns are ignored.
Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoforge.llm.caches import held
from demoforge.llm.common import on_workers
from demoforge.llm.encode import PIECE_BYTES, PRETOKEN, WordMemo, byte_letters, plain_byte_level, slices

NEVER = 1 << 60


#: longer shared prefixes of neighbours in the trie are followed again from here
SHARED = 48


def shared_prefixes(words: list[bytes]) -> list[int]:
    """For each of the sorted words, how many bytes it shares with the word
    before it, up to ``SHARED``."""
    if not words:
        return []
    table = np.frombuffer(b"".join([w[:SHARED].ljust(SHARED, b"\0") for w in words]), dtype=np.uint8).reshape(-1, SHARED)
    same = np.cumprod(table[1:] == table[:-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    size = np.array([len(w) for w in words])
    return [0, *np.minimum(same, np.minimum(size[1:], size[:-1])).tolist()]


class TrieBPE:
    """One byte-level BPE vocabulary (a tokenizers JSON file)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if not plain_byte_level(spec):
            raise ValueError("only plain byte-level BPE files are supported")
        raw = lambda s: bytes(letters[c] for c in s)
        self.find = regex.compile(PRETOKEN).findall
        ids = {raw(s): i for s, i in model["vocab"].items()}
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*ids.values(), *special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in ids.items():
            self.bytes_of[i] = b
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.special = special
        self.cut_special = regex.compile("|".join(f"({regex.escape(s)})" for s in special)).split if special else None
        # merges: (left, right) -> rank; the token's own two halves
        self.rank: dict[int, int] = {}
        halves: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            t = ids[a + b]
            self.rank[ids[a] << 32 | ids[b]] = r
            halves.setdefault(t, (ids[a], ids[b], r))
        # edges: from the outermost byte to the whole token, with the rank that ends each step
        self.right: list = [None] * size
        self.left: list = [None] * size
        for t in sorted(ids.values(), key=lambda t: (t in halves, halves[t][2] if t in halves else 0)):
            if t in halves:
                a, b, r = halves[t]
                self.right[t] = [*self.right[b][:-1], (b, r), (t, NEVER)]
                self.left[t] = [*self.left[a][:-1], (a, r), (t, NEVER)]
            else:
                self.right[t] = self.left[t] = [(t, NEVER)]
        self.pairs: dict[int, bool] = {}
        # a token counts if merging its bytes alone gives it back
        alone: dict[int, bool] = {}
        for b, t in sorted(ids.items(), key=lambda x: len(x[0])):
            alone[t] = t not in halves or (alone[halves[t][0]] and alone[halves[t][1]] and self._apart(halves[t][0], halves[t][1], inner=True))
        self._automaton({b: t for b, t in ids.items() if alone[t]})

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        """States are the prefixes of tokens: the state after some bytes is the
        longest one that ends there.  ``step[state][byte]`` leads on,
        ``ends[state]`` has the tokens that end there, the longest first."""
        number, step, ends, own = {b"": 0}, [{}], [()], [None]
        for b, t in tokens.items():
            for k in range(1, len(b) + 1):
                if b[:k] not in number:
                    number[b[:k]] = len(step)
                    step[number[b[:k - 1]]][b[k - 1]] = len(step)
                    step.append({})
                    ends.append(())
                    own.append(None)
            own[number[b]] = (t, len(b))
        back = [0] * len(step)
        level = [0]
        while level:
            deeper = []
            for s in level:
                for c, n in step[s].items():
                    f = back[s]
                    while s and f and c not in step[f]:
                        f = back[f]
                    back[n] = step[f].get(c, 0) if s else 0
                    ends[n] = ((own[n],) if own[n] else ()) + ends[back[n]]
                    deeper.append(n)
            level = deeper
        self.step, self.back, self.ends = step, back, ends
        self.lead: dict[int, int] = {}

    def _next(self, state: int, byte: int) -> int:
        """Where ``byte`` leads from a state that has no step of its own for it."""
        key = state << 8 | byte
        n = self.lead.get(key)
        if n is None:
            f = state
            while f and byte not in self.step[f]:
                f = self.back[f]
            n = self.lead[key] = self.step[f].get(byte, 0)
        return n

    def _apart(self, a: int, b: int, inner: bool = False) -> bool:
        """Do tokens a, b stay apart when their bytes are merged together?
        ``inner``: leave out the merge of the two whole tokens."""
        xs, ys, rank = self.right[a], self.left[b], self.rank
        i = j = 0
        while True:
            x, rx = xs[i]
            y, ry = ys[j]
            if inner and rx == NEVER and ry == NEVER:
                return True
            r = rank.get(x << 32 | y, NEVER)
            # of equal ranks the leftmost merges first
            if r < rx and r <= ry and r != NEVER:
                return False
            if rx == NEVER and ry == NEVER:
                return True
            if rx <= ry:
                i += 1
            else:
                j += 1

    def words(self, words: set[bytes]) -> dict[bytes, list[int]]:
        """Encodings of different non-empty words through one trie: in sorted
        order the words are its leaves from left to right, and the stacks hold
        the path to the present one, with the automaton's state and the last
        token of every prefix.  A word goes on from the prefix that it shares
        with the word before it."""
        order = sorted(words)
        out: dict[bytes, list[int]] = {}
        size, pairs, apart = self.bytes_of, self.pairs, self._apart
        step, ends, lead = self.step, self.ends, self._next
        last, states = [-1], [0]
        for w, shared in zip(order, shared_prefixes(order)):
            del last[shared + 1:], states[shared + 1:]
            state, depth = states[shared], shared
            for c in w[shared:]:
                depth += 1
                state = step[state].get(c) or lead(state, c)
                # of the tokens that end here, the longest that stays apart from the one before it
                for t, n in ends[state]:
                    if n == depth:
                        break
                    key = last[depth - n] << 32 | t
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = apart(last[depth - n], t)
                    if ok:
                        break
                last.append(t)
                states.append(state)
            ids = []
            while depth:
                t = last[depth]
                ids.append(t)
                depth -= len(size[t])
            ids.reverse()
            out[w] = ids
        if len(pairs) > 2_000_000:
            pairs.clear()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = []
        for t in texts:
            if self.cut_special and any(s in t for s in self.special):
                parts = [p for p in self.cut_special(t) if p]
            else:
                parts = [t]
            cut.append([x for p in parts for x in ([p] if p in self.special else self.find(p))])
        words = {w: w.encode() for c in cut for w in c}
        found = self.words({b for w, b in words.items() if w not in self.special})
        ids = {w: np.array([self.special[w]] if w in self.special else found[b], dtype="<u4").tobytes() for w, b in words.items()}
        return [b"".join([ids[w] for w in c]) for c in cut]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def loaded(path: str) -> tuple[TrieBPE, WordMemo, tuple]:
    """The vocabulary, its word memo, and by id the decimal id with a comma and
    the token's bytes (Arrow arrays), one per worker."""

    def make():
        import pyarrow as pa

        t = TrieBPE(path)
        names = pa.array([b"%d," % i for i in range(len(t.bytes_of))], pa.large_binary())
        words = WordMemo(lambda words, texts: t.encode([" " + w for w in words] + texts), tuple(t.special), lines=True)
        return t, words, (names, pa.array(t.bytes_of, pa.large_binary()))

    return held(("trie", path), make)


def _joined(table, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The entries of each text's ids after each other."""
    import pyarrow as pa

    _, at, data = table.take(pa.array(ids)).buffers()
    if not len(ids):
        return [b""] * (len(bounds) - 1)
    b = np.frombuffer(at, np.int64)[bounds].tolist()
    raw = data.to_pybytes()
    return [raw[x:y] for x, y in zip(b, b[1:])]


def encode_documents(docs: DataFrame, tokenizer: str, with_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256; ``with_text`` adds ids and decoded text.  No shuffle: each
    task works on its rows in pieces, with a bounded memo of words."""
    on_workers(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_text:
        schema += ", ids array<int>, decoded string"

    def run(batches):
        import pyarrow as pa

        _, memo, (names, raws) = loaded(tokenizer)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for piece in slices(batch, PIECE_BYTES):
                all_ids, bounds = memo.ids(piece.column("text"))
                n = np.diff(bounds)
                ids_sha = [sha(x[:-1]) for x in _joined(names, all_ids, bounds)]
                texts = [x.decode("utf-8", "replace") for x in _joined(raws, all_ids, bounds)]
                text_sha = [sha(x.encode()) for x in texts]
                if with_text:
                    ids = [all_ids[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:])]
                cols = [piece.column("doc_id"), pa.array(n), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_text:
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
