"""Secret scan: fixed patterns, and values that would be hard to guess.

Three fixed kinds (``assign``, ``access``, ``hex``) are found by patterns,
leftmost and without overlaps in each kind.  Beyond them, values in credential
contexts (wider key words, quoted and symbol-rich values, passwords in URLs) get
a guess cost: the cheapest way to build the value out of words, dates, repeats,
keyboard walks and brute-force spans, found by dynamic programming over its
places.  A value outside the fixed spans that costs at least ``MIN_BITS`` is
added as kind ``guess``.

Costs are in bits (log2 of guesses).  Words are the letter entries of a public
byte-level vocabulary (its path is a parameter), whose ids follow their
frequency: the rank is the guess number; capitals and look-alike digits add to
it.  A new segment costs ``SEGMENT_BITS``.

Each task scans its rows by itself; no shuffle, so neither a hot source nor a
value that stands in a third of all rows matters.  Arrow's linear-time matcher
picks the texts that can hold a kind at all, positions come from Python's
matcher on those; both see whole texts.

Nulls and empty texts have no spans.  Texts and values are read whole (segments
other than brute force and repeats are at most ``LONGEST`` characters, so the
cost of a long value stays linear).  Ties between equally cheap segmentations do
not change the cost.  Repeated rows are scanned as often as they occur; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from math import log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demoforge.llm.caches import held
from demoforge.llm.common import on_workers
from demoforge.llm.encode import slices

#: a value that takes at least 2**MIN_BITS guesses counts as a secret
MIN_BITS = 40.0
#: values shorter than this are not scored
MIN_VALUE = 8
SEGMENT_BITS = 2.0
LONGEST = 24

# fixed values: the base patterns and their least lengths
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_VALUE = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the run of such characters from the first AKIA on, 16 in all
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs

#: a key word of a credential context, its separator, and a quoted or bare value
CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|(?:access|private|account|encryption)[ _-]?key"""
    r"""|credentials?|auth(?:orization)?|bearer)["'`]?\x20{0,8}(?::=|=>|==?|:|\x20is\x20|(?<=bearer)\x20)\x20{0,8}(?:bearer\x20+)?"""
    r"""(?:"([^"\n]+)"|'([^'\n]+)'|`([^`\n]+)`|([^\s"'`]+))""", re.I | re.A)
#: the password of a URL's user
LOGIN = re.compile(r"[a-z][a-z0-9+.-]{0,31}://[^\s/:@]{1,256}:([^\s/@]+)@", re.I | re.A)

# what a text must hold for a kind to be possible, for Arrow's matcher
_MAY_ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=]"
_MAY_CONTEXT = r"(?i)(?:pass|pwd|secret|token|key|credential|auth|bearer)[a-z]*[\"'`]? {0,8}(?:[:=]| is )|bearer |://[^\s/:@]+:"

# fixed values: a keyboard's rows with the shift of each row in half keys
ROWS = (("`1234567890-=", 0), ("qwertyuiop[]\\", 3), ("asdfghjkl;'", 4), ("zxcvbnm,./", 5))
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
# fixed values: digits and signs that stand for letters
LOOKS = str.maketrans({"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "l", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "2": "z"})

DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?"
                  r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|[12]\d|3[01])\2(?:19|20)\d\d")
DATE_BITS = {True: log2(200), False: log2(200 * 365)}


def _keys() -> dict[str, tuple[float, int]]:
    return {c: (i * 2 + shift, y) for y, (row, shift) in enumerate(ROWS) for i, c in enumerate(row)}


_KEYS = _keys()


@lru_cache(4096)
def _step(a: str, b: str):
    """The direction from key a to key b if they touch, else None."""
    a, b = (SHIFTED.get(c, c.lower()) for c in (a, b))
    if a not in _KEYS or b not in _KEYS:
        return None
    (xa, ya), (xb, yb) = _KEYS[a], _KEYS[b]
    near = (abs(xa - xb) == 2) if ya == yb else (abs(ya - yb) == 1 and abs(xa - xb) <= 2)
    return (xb - xa, yb - ya) if near else None


class GuessCost:
    """Guess cost of values, with the words of a vocabulary file."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.words: dict[str, float] = {}
        for entry, i in vocab.items():
            word = entry.removeprefix("Ġ").lower()
            if len(word) >= 3 and word.isascii() and word.isalpha():
                self.words[word] = min(self.words.get(word, 99.0), log2(i + 1))

    def word_bits(self, s: str) -> float | None:
        low = s.lower()
        bits = self.words.get(low)
        extra = 0.0
        if bits is None:
            plain = low.translate(LOOKS)
            bits = self.words.get(plain) if plain != low else None
            if bits is None:
                return None
            extra = 1.0 + sum(a != b for a, b in zip(low, plain))
        upper = sum(c.isupper() for c in s)
        if upper:
            extra += 1.0 if upper == len(s) or (upper == 1 and s[0].isupper()) else 1.0 + upper
        return bits + extra

    @staticmethod
    def letter_bits(value: str) -> float:
        """Bits of a brute-force character: the sizes of the value's classes."""
        size = 10 * any("0" <= c <= "9" for c in value) + 26 * any("a" <= c <= "z" for c in value)
        size += 26 * any("A" <= c <= "Z" for c in value) + 33 * any(c.isascii() and not c.isalnum() for c in value)
        return log2(max(10, size + 100 * any(not c.isascii() for c in value)))

    def spans(self, value: str):
        """(start, end, kind, bits) of all segments but brute force."""
        n, letter = len(value), self.letter_bits(value)
        for i in range(n):
            for j in range(i + 3, min(n, i + LONGEST) + 1):
                bits = self.word_bits(value[i:j])
                if bits is not None:
                    yield i, j, "word", bits
            if value[i].isdigit():
                for j in {i + 4, i + 8, i + 10}:
                    m = DATE.fullmatch(value, i, j) if j <= n else None
                    if m:
                        yield i, j, "date", DATE_BITS[j == i + 4] + 2.0 * bool(m.group(1) or m.group(2))
            turns, way, j = 0, None, i + 1
            while j < min(n, i + LONGEST):
                step = _step(value[j - 1], value[j])
                if step is None:
                    break
                turns += step != way
                way = step
                j += 1
                if j - i >= 4:
                    yield i, j, "walk", log2(len(_KEYS)) + 2.2 * turns + log2(j - i)
        for size in range(1, 5):  # maximal runs of a repeated block, from each of its first places
            i = 0
            while i + 2 * size <= n:
                j = i
                while j + size < n and value[j] == value[j + size]:
                    j += 1
                for k in range(i, min(i + size, j)):
                    times = (j + size - k) // size
                    if times >= 2 and times * size >= 3:
                        yield k, k + times * size, "repeat", size * letter + log2(times)
                i = max(i + 1, j)

    def cost(self, value: str) -> tuple[float, list[tuple[str, int, int]]]:
        """The least bits of a segmentation, and its segments."""
        letter, n = self.letter_bits(value), len(value)
        into: dict[int, list] = {}
        for i, j, kind, bits in self.spans(value):
            into.setdefault(j, []).append((i, kind, bits))
        # any: cheapest for the first j characters; brute: with brute force at their end
        any_cost, brute = [0.0] * (n + 1), [float("inf")] * (n + 1)
        how: list = [None] * (n + 1)
        since = [0] * (n + 1)
        for j in range(1, n + 1):
            go, start = brute[j - 1] + letter, any_cost[j - 1] + SEGMENT_BITS + letter
            brute[j], since[j] = (go, since[j - 1]) if go <= start else (start, j - 1)
            best, how[j] = brute[j], ("brute", since[j])
            for i, kind, bits in into.get(j, ()):
                if any_cost[i] + SEGMENT_BITS + bits < best:
                    best, how[j] = any_cost[i] + SEGMENT_BITS + bits, (kind, i)
            any_cost[j] = best
        segments, j = [], n
        while j:
            kind, i = how[j]
            segments.append((kind, i, j))
            j = i
        return any_cost[n], segments[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds, ascending."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_VALUE]
    out += [(m.start(), k, m.end()) for k, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
    return sorted(out)


def credential_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in credential contexts."""
    out = set()
    for p in (CONTEXT, LOGIN):
        for m in p.finditer(text):
            a, b = m.span(m.lastindex)
            if m.lastindex == 4:  # a bare value: without what closes the sentence or call around it
                while b > a and text[b - 1] in ",;.)]}>":
                    b -= 1
            if b - a >= MIN_VALUE:
                out.add((a, b))
    return sorted(out)


def _picked(column) -> tuple[np.ndarray, np.ndarray]:
    """Which texts can hold a fixed span, and which a credential context."""
    import pyarrow.compute as pc

    has = lambda p: np.asarray(pc.match_substring_regex(column, p))
    return has(_MAY_ASSIGN) | np.asarray(pc.match_substring(column, "AKIA")) | has("[0-9a-f]{32}"), has(_MAY_CONTEXT)


def _found(vocabulary: str, column):
    """For every text (start, kind, end, bits) of its spans; bits of the fixed
    kinds are null."""
    import pyarrow.compute as pc

    model = held(("guess", vocabulary), lambda: GuessCost(vocabulary))
    col = pc.fill_null(column, "")
    fixed, context = _picked(col)
    known: dict[str, float] = {}
    out: list = [()] * len(col)
    for k in np.flatnonzero(fixed | context).tolist():
        text = col[k].as_py()
        spans = [(*s, None) for s in base_spans(text)] if fixed[k] else []
        for a, b in credential_values(text) if context[k] else ():
            if any(x <= a and b <= y for x, _, y, _ in spans):
                continue  # inside a fixed span
            value = text[a:b]
            bits = known.get(value)
            if bits is None:
                bits = known[value] = model.cost(value)[0]
            if bits >= MIN_BITS:
                spans.append((a, 3, b, bits))
        out[k] = sorted(spans, key=lambda s: s[:3])
    return out


def _texts(docs: DataFrame) -> DataFrame:
    on_workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def findings(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row a span: doc_id, kind, start, end (code points, exclusive), value
    and, for kind guess, bits."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 4_000_000):
                rows = []
                for k, spans in enumerate(_found(vocabulary, piece.column("text"))):
                    if spans:
                        text = piece.column("text")[k].as_py()
                        doc = piece.column("doc_id")[k].as_py()
                        rows += [(doc, KINDS[kind], a, b, text[a:b], bits) for a, kind, b, bits in spans]
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                                 names=["doc_id", "kind", "start", "end", "value", "bits"])

    return _texts(docs).mapInArrow(run, "doc_id long, kind string, start long, end long, value string, bits double")


def scan(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256 (of
    kind:start:end, comma-joined), spans (all spans, written likewise), n_guess."""

    def run(batches):
        import pyarrow as pa

        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for piece in slices(batch, 4_000_000):
                count = np.zeros((4, len(piece)), dtype=np.int64)
                base, every = [nothing] * len(piece), [""] * len(piece)
                for k, spans in enumerate(_found(vocabulary, piece.column("text"))):
                    if not spans:
                        continue
                    names = [f"{KINDS[kind]}:{a}:{b}" for a, kind, b, _ in spans]
                    for _, kind, _, _ in spans:
                        count[kind, k] += 1
                    base[k] = hashlib.sha256(",".join([x for x, s in zip(names, spans) if s[1] < 3]).encode()).hexdigest()
                    every[k] = ",".join(names)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *map(pa.array, count[:3]), pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array(count[3])],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    return _texts(docs).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
