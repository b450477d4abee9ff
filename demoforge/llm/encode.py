"""Token ids of whole texts, word by word with a memo.

A byte-level pre-tokeniser never lets a token run across a single space that
has a non-space character on both sides: the space opens the next word.  So a
text without other white space beside its spaces can be cut at its spaces.  A
line end between two non-space characters is a pre-token of its own, so such a
text can be cut before its line ends too.  A piece of texts is cut and its words
are numbered by Arrow; each different word of a piece is looked up or encoded
once, and the ids of all texts are gathered from one array of the words' ids."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

from demoforge.llm.caches import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: strings in each of a memo's two generations
MEMO_WORDS = 150_000
#: words in an array memo, in MEMO_WORDS (a word takes about 60 bytes there)
ARRAY_MEMO = 3
#: longer words are encoded but not remembered
MEMO_LENGTH = 64
#: bytes of text that are cut together
PIECE_BYTES = 4_000_000

#: white space beside a space, or white space that the plain cut does not know
_UNSAFE = (r"  | [\t\n\x0b\x0c\r]|[\t\n\x0b\x0c\r] |"
           r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: a line end that may not stand alone between two other characters
_BESIDE_LINE_END = r"[\t\n\x0b\x0c\r]{2}"

#: pre-tokens of a byte-level tokeniser (fixed pattern of its file format)
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level
    vocabulary: printable Latin-1 bytes stand for themselves, the others take
    the code points from 256 on in ascending order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_byte_level(spec: dict) -> bool:
    """Is this tokenizers JSON a byte-level BPE without further steps?"""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    return bool(spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                and not pre.get("add_prefix_space") and spec.get("post_processor") is None
                and not model.get("ignore_merges") and not model.get("dropout"))


class Cut:
    """A column of texts cut into heads and words.

    ``heads``: what each text begins with, up to its first cut; ``words``: the
    different words that follow a space; ``index[bounds[k]:bounds[k + 1]]``:
    the words of text k.  With ``lines`` words that begin with a line end follow
    what is before them without a space."""

    def __init__(self, column, specials: tuple[str, ...] = (), lines: bool = False):
        import pyarrow as pa
        import pyarrow.compute as pc

        col = pc.fill_null(column, "")
        n = len(col)
        whole = np.zeros(n, dtype=bool)
        for s in specials:
            whole |= np.asarray(pc.match_substring(col, s))
        odd = whole | np.asarray(pc.match_substring_regex(col, _UNSAFE))
        even = col.filter(pa.array(~odd)) if odd.any() else col
        if lines:
            at_ends = pc.replace_substring(even, "\n", " \n")
            beside = pc.match_substring_regex(even, _BESIDE_LINE_END)
            even = pc.if_else(beside, even, at_ends) if pc.any(beside).as_py() else at_ends
        cut = pc.split_pattern(even, " ")
        sizes = np.asarray(pc.list_value_length(cut)).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        values = cut.flatten()
        tail = np.ones(len(values), dtype=bool)
        tail[first] = False
        heads = np.empty(n, dtype=object)
        heads[~odd] = values.take(pa.array(first)).to_pylist()
        count = np.zeros(n, dtype=np.int64)
        count[~odd] = sizes - 1
        values = values.filter(pa.array(tail))
        if odd.any():
            rest: list[str] = []
            for k in np.flatnonzero(odd).tolist():
                t = col[k].as_py()
                words = [t] if whole[k] else _SAFE.split(t)
                heads[k] = words[0]
                count[k] = len(words) - 1
                rest += words[1:]
            values = pa.concat_arrays([values, pa.array(rest, values.type)])
        coded = values.dictionary_encode()
        self.different = coded.dictionary
        index = np.asarray(coded.indices)
        if odd.any():  # the odd texts' words stand behind the others
            order = np.argsort(odd, kind="stable")
            own = count[order]
            start = np.empty(n, dtype=np.int64)
            start[order] = np.cumsum(own) - own
            self.bounds = np.concatenate([[0], np.cumsum(count)])
            index = index[np.repeat(start - self.bounds[:-1], count) + np.arange(len(index))]
        else:
            self.bounds = np.concatenate([[0], np.cumsum(count)])
        self.index, self.heads = index, heads.tolist()

    @property
    def words(self) -> list[str]:
        return self.different.to_pylist()


class Memo:
    """Values of strings, worked out in batches.  Two generations: a full one
    becomes the older one, what is asked for again moves to the younger, so
    frequent strings stay and memory is bounded."""

    def __init__(self, compute: Callable[[list[str]], list], size: int | None = None):
        self.compute, self.size = compute, size
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def of(self, keys: list[str]) -> list:
        young = self.young
        out = list(map(young.get, keys))
        if None in out:
            at = [k for k, v in enumerate(out) if v is None]
            miss = [keys[k] for k in at]
            got = list(map(self.old.get, miss)) if self.old else [None] * len(miss)
            if None in got:
                new = list(dict.fromkeys([m for m, g in zip(miss, got) if g is None]))
                found = dict(zip(new, self.compute(new)))
                got = [found[m] if g is None else g for m, g in zip(miss, got)]
            for k, v in zip(at, got):
                out[k] = v
            young.update([(m, g) for m, g in zip(miss, got) if len(m) <= MEMO_LENGTH])
        if len(young) > (self.size or MEMO_WORDS):
            self.old, self.young = young, {}
        return out


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start:start + size] of all pairs after each other, and where each ends."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(len(at))
    return flat[at], ends


class ArrayMemo:
    """Ids of words in one array, worked out in batches.  When it is full, the
    words that were asked for again stay, and those of the last batch."""

    def __init__(self, compute: Callable[[list[str]], list[bytes]]):
        import pyarrow as pa

        self.compute = compute
        self.keys, self.flat = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)

    def of(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of an Arrow array of different words: the array of ids, and where
        each word's ids start in it and how many they are."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words = words.cast(pa.string())
        at = np.asarray(pc.fill_null(pc.index_in(self.keys, value_set=words), -1)) if len(words) else np.full(len(self.keys), -1)
        known = at >= 0
        self.again |= known
        starts, sizes = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        starts[at[known]], sizes[at[known]] = self.starts[known], self.sizes[known]
        miss = np.flatnonzero(starts < 0)
        new = words.take(pa.array(miss))
        values = self.compute(new.to_pylist())
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(values), "<u4")])
        size = np.array([len(v) // 4 for v in values], dtype=np.int64)
        start = len(self.flat) + np.cumsum(size) - size
        starts[miss], sizes[miss] = start, size
        self._keep(new, start, size, flat, known)
        return flat, starts, sizes

    def _keep(self, new, start: np.ndarray, size: np.ndarray, flat: np.ndarray, known: np.ndarray) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        short = np.asarray(pc.less_equal(pc.utf8_length(new), MEMO_LENGTH))
        whole = bool(short.all())
        if not whole:
            new, start, size = new.filter(pa.array(short)), start[short], size[short]
        keys = pa.concat_arrays([self.keys, new])
        again = np.concatenate([self.again, np.zeros(len(new), bool)])
        starts, sizes = np.concatenate([self.starts, start]), np.concatenate([self.sizes, size])
        if len(keys) > ARRAY_MEMO * MEMO_WORDS:
            stay = self.again if 2 * self.again.sum() <= ARRAY_MEMO * MEMO_WORDS else known
            stay = np.concatenate([stay, np.ones(len(new), bool)])
            keys, starts, sizes = keys.filter(pa.array(stay)), starts[stay], sizes[stay]
            again, whole = np.zeros(len(keys), bool), False
        if not whole:
            flat, ends = gathered(flat, starts, sizes)
            starts = ends - sizes
        self.keys, self.flat, self.starts, self.sizes, self.again = keys, flat, starts, sizes, again


class WordMemo:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``encode`` maps words that follow a space, and texts as they are, to such
    bytes in one list; ``specials`` are strings that the tokeniser takes as one
    token: a text that holds one is encoded whole.  ``lines``: the tokeniser
    takes a line end between two non-space characters by itself."""

    def __init__(self, encode: Callable[[list[str], list[str]], list], specials: tuple[str, ...] = (), lines: bool = False):
        self.specials, self.lines, self.encode = specials, lines, encode
        self.words, self.heads = ArrayMemo(self._words), Memo(lambda texts: encode([], texts))

    def _words(self, words: list[str]) -> list[bytes]:
        begin = [k for k, w in enumerate(words) if w[:1] == "\n"] if self.lines else []
        if not begin:
            return self.encode(words, [])
        mine = set(begin)
        got = self.encode([w for k, w in enumerate(words) if k not in mine], [words[k][1:] for k in begin])
        n = len(words) - len(begin)
        end, rest, spaced = self.heads.of(["\n"])[0], iter(got[n:]), iter(got[:n])
        return [end + next(rest) if k in mine else next(spaced) for k in range(len(words))]

    def ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, and the texts' bounds in them."""
        import pyarrow as pa

        cut = Cut(pa.array(column, pa.string()) if isinstance(column, list) else column, self.specials, self.lines)
        flat, starts, sizes = self.words.of(cut.different)
        heads = self.heads.of(cut.heads)
        size = np.array([len(h) // 4 for h in heads], dtype=np.int64)
        starts = np.concatenate([starts, len(flat) + np.cumsum(size) - size])
        sizes = np.concatenate([sizes, size])
        flat = np.concatenate([flat, np.frombuffer(b"".join(heads), "<u4")])
        # every text is its head and then its words
        at = cut.bounds[:-1] + np.arange(len(heads))
        units = np.empty(len(cut.index) + len(heads), dtype=np.int64)
        tail = np.ones(len(units), dtype=bool)
        tail[at] = False
        units[at], units[tail] = len(cut.different) + np.arange(len(heads)), cut.index
        out, ends = gathered(flat, starts[units], sizes[units])
        return out, np.concatenate([[0], ends])[np.append(at, len(units))]

    def batch(self, column) -> list[bytes]:
        ids, bounds = self.ids(column)
        raw, b = ids.tobytes(), (4 * bounds).tolist()
        return [raw[x:y] for x, y in zip(b, b[1:])]


#: pre-tokens that the model takes in one call
BLOCK = 200


def _old_letters() -> tuple[str, str]:
    """Letters and numbers from U+00A1 to U+024F, on which all Unicode versions agree."""
    import unicodedata

    own = [chr(c) for c in range(0xA1, 0x250)]
    return tuple("".join(c for c in own if unicodedata.category(c)[0] == k) for k in "LN")


_L, _N = _old_letters()
#: the pattern of pre-tokens for strings of printable characters below U+0250
_OLD_PRETOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{_L}]+| ?[0-9{_N}]+| ?[^\sA-Za-z0-9{_L}{_N}]+|\s+(?!\S)|\s+")
#: one such word after at most one space
_OLD_WORD = re.compile("(?: ?[!-~\xa1-\u024f]+)?").fullmatch
_OLD_WORDS = re.compile("(?:(?: ?[!-~\xa1-\u024f]+)?\n)*").fullmatch


class ByModel:
    """Encodes words through the library's own model.

    Words of old alphabets are cut into pre-tokens (the fixed pattern of the
    file format) in one call for many, different pre-tokens are remembered, and
    the model takes new ones in blocks, set apart by a control character that no
    longer vocabulary entry holds: nothing merges across it."""

    def __init__(self, tokenizer, spec: dict):
        from tokenizers import Tokenizer

        self.letters = {b: c for c, b in byte_letters().items()}
        self.model, self.memo = Tokenizer(tokenizer.model), Memo(self._encode)
        vocab = spec["model"]["vocab"]
        longer = set("".join(e for e in vocab if len(e) > 1))
        free = [b for b in range(1, 9) if self.letters[b] in vocab and self.letters[b] not in longer]
        self.apart = plain_byte_level(spec) and bool(free)
        if self.apart:
            self.gap, self.gap_id = chr(free[0]), vocab[self.letters[free[0]]]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a in range(0, len(pieces), BLOCK):
            part = pieces[a:a + BLOCK]
            block = self.gap.join(part)
            if block.isascii():  # printable characters stand for themselves
                block = block.replace(" ", self.letters[32]).replace("\n", self.letters[10]).replace(self.gap, self.letters[ord(self.gap)])
            else:
                block = block.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.model.encode(block, add_special_tokens=False).ids, dtype="<u4")
            at = [-4, *(4 * np.flatnonzero(ids == self.gap_id)).tolist(), 4 * len(ids)]
            if len(at) != len(part) + 1:
                raise ValueError("the model joins tokens across control characters")
            raw = ids.tobytes()
            out += [raw[x + 4:y] for x, y in zip(at, at[1:])]
        return out

    def words(self, texts: list[str]) -> list[bytes | None]:
        """Ids of the words of old alphabets; None for other texts."""
        lines = "\n".join(texts) + "\n"
        if texts and not (_OLD_WORDS(lines) and lines.count("\n") == len(texts)):
            fit = [t if "\n" not in t and _OLD_WORD(t) else "" for t in texts]
            got = self.words(fit)
            return [g if f or not t else None for g, f, t in zip(got, fit, texts)]
        found = _OLD_PRETOKEN.findall(lines)
        out: list[bytes | None] = []
        got: list[bytes] = []
        for piece, ids in zip(found, self.memo.of(found)):
            if piece[-1] == "\n":  # the ends of one word and of empty ones behind it
                out.append(b"".join(got))
                out += [b""] * (len(piece) - 1)
                got = []
            else:
                got.append(ids)
        return out


def library_encoder(path: str, plain: bool = False) -> WordMemo:
    """The tokenizers library behind a word memo, one per worker process.
    ``plain``: special tokens' strings in a text are ordinary text."""

    def make() -> WordMemo:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = plain
        model = t.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # the memo remembers words already
            t.model = model
        specials = () if plain else tuple(a.content for a in t.get_added_tokens_decoder().values())
        with open(path, encoding="utf-8") as f:
            by_model = ByModel(t, json.load(f))

        def texts(many: list[str]) -> list[bytes]:
            out = by_model.words(many) if by_model.apart else [None] * len(many)
            for x in specials:
                if any(x in s for s in many):
                    out = [None if x in s else ids for ids, s in zip(out, many)]
            far = [k for k, ids in enumerate(out) if ids is None]
            for k, e in zip(far, t.encode_batch_fast([many[k] for k in far], add_special_tokens=False)):
                out[k] = np.array(e.ids, dtype="<u4").tobytes()
            return out

        return WordMemo(lambda words, heads: texts([" " + w for w in words] + heads), specials, by_model.apart)

    return held(("library", path, plain), make)


def slices(batch, size: int = 1_000_000, column: str = "text"):
    """Cut an Arrow batch so that each part holds about ``size`` bytes of text
    (one row at least)."""
    import pyarrow.compute as pc

    n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(n):
        return
    part = (np.cumsum(n) - n) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def texts_of(column) -> list[str]:
    """An Arrow string column as a list; null is the empty text."""
    return [t or "" for t in column.to_pylist()]
