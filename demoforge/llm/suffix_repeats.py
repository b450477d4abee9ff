"""Repeated byte strings by common-prefix interval trees over sparse suffixes.

A window of ``WINDOW`` bytes is repeated if the same bytes start anywhere else.
Every window selects an anchor, the place of the least hash among its
``GRAM``-byte strings (the leftmost of equals), so equal windows select the
same place in themselves.  Only suffixes that start at anchors are sorted:

1. equal texts are one class; a class of several rows is repeated as a whole;
2. anchors whose GRAM bytes occur once are dropped (counts combine before the
   shuffle); the others fetch their right context (WINDOW bytes from the
   anchor) and their left one (backwards, as far as a window can reach);
3. Spark sorts each anchor's different contexts by the right one, which makes a
   suffix array; common-prefix lengths of neighbours enhance it, and a stack
   scan walks its interval tree.  Within an interval the left contexts are
   scanned the same way; an interval of left extensions, which is left-diverse
   by construction, that is not inside one right child is a maximal repeat: it
   comes out with all its occurrences, not only with neighbours.
4. For what is covered (not for ``groups``, which scans an anchor whole), an
   anchor with more than ``GROUP_ROWS`` different contexts is scanned in chunks; what repeats across chunks is found by counting the contexts'
   windows by 128-bit hash, and only windows that reach beyond what a chunk has
   covered already are looked up in the counts.

All repeats around an anchor contain the anchor, so what they cover of an
occurrence is one run: the longest left and the longest right extension.

Nulls: a null text is the empty text.  Texts below WINDOW bytes lose nothing.
Texts may be of any length (they are read in blocks).  Rows that repeat a
doc_id, null ids included, are told apart by their texts; equal rows are copies
of each other.  An empty table gives an empty result.  ``removals`` ignores
other columns, ``remove`` carries them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoforge.llm.common import Workspace, fresh, join_ids, key_groups, shuffle_join
from demoforge.llm.encode import slices

WINDOW = 200
GRAM = 64
#: different contexts of an anchor that one task scans
GROUP_ROWS = 2000
#: window starts that a task hashes at once
BLOCK = 1 << 20


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place (GRAM is a power of 2)."""
    rng = np.random.RandomState(7)
    h = rng.randint(1, 1 << 62, 256).astype(np.uint64)[data]
    size = 1
    while size < GRAM:
        a, b = h[:-size], h[size:]
        h = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        size *= 2
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes that the windows of ``data`` select; ``last`` marks
    window starts that are inside one text."""
    reach = WINDOW - GRAM + 1
    places, hashes = [], []
    for a in range(0, max(len(data) - WINDOW + 1, 0), BLOCK):
        part = data[a:a + BLOCK + WINDOW - 1]
        h = _gram_hashes(part)
        # order by the hash's upper bits, then by place
        key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= reach:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        key = np.minimum(key[: len(key) - (reach - size)], key[reach - size:])
        key = key[last[a:a + len(key)]]
        at = np.unique(key & np.uint64((1 << 24) - 1)).astype(np.int64)
        places.append(at + a)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, h = np.concatenate(places), np.concatenate(hashes)
    p, first = np.unique(p, return_index=True)
    return p, h[first]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # equal up to lo, different up to hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lcp: list[int], least: int):
    """(length, first, last) of every interval of the common-prefix tree with
    length >= least; lcp[i] belongs to entries i - 1 and i, lcp[0] is unused."""
    stack = [(least - 1, 0)]
    for i in range(1, len(lcp) + 1):
        v, start = (max(lcp[i], least - 1) if i < len(lcp) else least - 1), i - 1
        while stack[-1][0] > v:
            length, start = stack.pop()
            yield length, start, i - 1
        if stack[-1][0] < v:
            stack.append((v, start))


def maximal_repeats(left: list[bytes], right: list[bytes]):
    """Entries sorted by right context -> (left extension, right extension,
    entries) of every maximal repeat of WINDOW bytes or more around the anchor."""
    lcp = [0] + [common_prefix(a, b) for a, b in zip(right, right[1:])]
    least = max(1, WINDOW - max((len(x) for x in left), default=0))
    if len(left) == 2:
        r, e = lcp[1], common_prefix(left[0], left[1])
        if r + e >= WINDOW:
            yield e, r, [0, 1]
        return
    for length, a, b in intervals(lcp, least):
        need = max(WINDOW - length, 0)
        own = sorted((i for i in range(a, b + 1) if len(left[i]) >= need), key=lambda i: left[i])
        ext = [0] + [common_prefix(left[i], left[j]) for i, j in zip(own, own[1:])]
        whole = [(0, 0, len(own) - 1)] if need == 0 and len(own) > 1 and min(ext[1:]) == 0 else []
        for e, x, y in [*whole, *intervals(ext, max(need, 1))]:
            got = sorted(own[x:y + 1])
            if len(got) > 1 and min(lcp[got[0] + 1:got[-1] + 1]) == length:
                yield e, length, got


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _classes(ws: Workspace, docs: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Rows with their text digest and class size, and the expression of the
    key that finds a row's text again."""
    text = _text(F.col("text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"),
                       F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64("doc_id", text).alias("mix"))
    rows = ws.save(base, "rows")
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    plain = repeated.isEmpty()
    rows = rows.withColumn("key", F.col("doc_id") if plain else F.col("mix"))
    key = F.col("doc_id").cast("long") if plain else F.xxhash64(F.col("doc_id").cast("long"), text)
    return rows, ws.save(rows.groupBy("sha").agg(F.min("key").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "classes"), key


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """key, pos, h of every selected anchor of (key, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 1 << 20):
                size = np.array([len(t) for t in piece.column("text").cast(pa.binary()).to_pylist()], dtype=np.int64)
                data = np.frombuffer(b"".join(piece.column("text").cast(pa.binary()).to_pylist()), dtype=np.uint8)
                start = np.cumsum(size) - size
                inside = np.zeros(len(data), dtype=bool)
                for s, n in zip(start, size):
                    inside[s:s + max(n - WINDOW + 1, 0)] = True
                p, h = anchors(data, inside)
                row = np.searchsorted(start, p, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key").take(pa.array(row)), pa.array((p - start[row]).astype(np.int32)), pa.array(h.view(np.int64))],
                    names=["key", "pos", "h"])

    return texts.mapInArrow(run, "key long, pos int, h long")


def _contexts(joined: DataFrame) -> DataFrame:
    """(key, text, at: [pos, h]) -> key, pos, h, ctx (128-bit hash), left
    (backwards), right; the bytes only once per task and context."""

    def run(batches):
        import pyarrow as pa

        seen: set[bytes] = set()
        reach = WINDOW - GRAM
        names = ["key", "pos", "h", "ctx", "left", "right"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for piece in slices(batch, 1 << 19):
                out = []
                for key, t, at in zip(*(piece.column(c).to_pylist() for c in ("key", "text", "at"))):
                    b = t.encode()
                    for x in at:
                        pos, h = x["pos"], x["h"]
                        left, right = b[max(0, pos - reach):pos], b[pos:pos + WINDOW]
                        ctx = hashlib.blake2b(b"%d %d " % (h, len(left)) + left + right, digest_size=16).digest()
                        if ctx in seen:
                            left = right = None
                        else:
                            seen.add(ctx)
                            left = left[::-1]
                        out.append((key, pos, h, ctx, left, right))
                if len(seen) > 500_000:
                    seen.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return joined.mapInArrow(run, "key long, pos int, h long, ctx binary, left binary, right binary")


def _scan(sorted_contexts: DataFrame, groups: bool) -> DataFrame:
    """Contexts sorted by (h, chunk, right): what repeats cover of each context, or
    with ``groups`` every maximal repeat with all its contexts."""

    def run(batches):
        import pyarrow as pa

        schema = [("ctx", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())]
        if groups:
            schema = [("h", pa.int64()), ("chunk", pa.int32()), ("nth", pa.int32()), *schema]
        out = []

        def batch():
            cols = list(zip(*out)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], names=[n for n, _ in schema])

        for (h, chunk), g in key_groups(batches, ["h", "chunk"]):
            left, right, ctx, n = g["left"].tolist(), g["right"].tolist(), g["ctx"].tolist(), g["n"]
            cover: dict[int, tuple[int, int]] = {}
            nth = 0
            found = maximal_repeats(left, right) if len(left) > 1 else ()
            for e, r, members in found:
                for i in members:
                    if groups:
                        out.append((h, chunk, nth, ctx[i], e, r))
                    else:
                        lo, hi = cover.get(i, (0, 0))
                        cover[i] = max(lo, e), max(hi, r)
                nth += 1
            for i in np.flatnonzero(n > 1):
                if len(left[i]) + len(right[i]) >= WINDOW:
                    if groups:
                        out.append((h, chunk, nth, ctx[i], len(left[i]), len(right[i])))
                    else:
                        cover[i] = len(left[i]), len(right[i])
                    nth += 1
            out.extend((ctx[i], lo, hi) for i, (lo, hi) in cover.items())
            if len(out) > 50_000:
                yield batch()
                out = []
        yield batch()

    return sorted_contexts.mapInArrow(run, ("h long, chunk int, nth int, " if groups else "") + "ctx binary, lo int, hi int")


def _windows(contexts: DataFrame) -> DataFrame:
    """(h, ctx, left, right, lo, hi) -> ctx, o (bytes before the anchor), w (hash)
    of every window, and whether it reaches beyond [anchor - lo, anchor + hi)."""

    def run(batches):
        import pyarrow as pa

        types = (pa.binary(), pa.int32(), pa.binary(), pa.bool_())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for h, ctx, left, right, lo, hi in zip(*(part.column(c).to_pylist() for c in ("h", "ctx", "left", "right", "lo", "hi"))):
                    b = left[::-1] + right
                    for s in range(len(b) - WINDOW + 1):
                        # a window counts once for each place of the anchor in it
                        o = len(left) - s
                        w = hashlib.blake2b(b"%d %d " % (h, o) + b[s:s + WINDOW], digest_size=16).digest()
                        out.append((ctx, o, w, o > lo or WINDOW - o > hi))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["ctx", "o", "w", "beyond"])

    return contexts.select("h", "ctx", "left", "right", "lo", "hi").mapInArrow(run, "ctx binary, o int, w binary, beyond boolean")


def _across_chunks(contexts: DataFrame) -> DataFrame:
    """ctx, lo, hi that repeats in other chunks add."""
    windows = _windows(contexts)
    twice = windows.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    return (shuffle_join(windows.filter("beyond").select("ctx", "o", "w"), twice, "w").groupBy("ctx")
            .agg(F.max("o").alias("lo"), (F.lit(WINDOW) - F.min("o")).alias("hi")))


class Repeats:
    """One run of the search over (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        self.ws = ws = Workspace(docs.sparkSession, "repeats")
        self.rows, self.classes, self.key = _classes(ws, docs)
        key = self.key
        copies = ws.save(shuffle_join(self.rows, self.classes, "sha").filter("key <> rep").select("key").distinct(), "copies")
        texts = docs.select(key.alias("key"), _text(F.col("text")).alias("text")).filter(F.octet_length("text") >= WINDOW)
        self.texts = join_ids(texts, copies, ["key"], "left_anti")
        found = ws.save(_anchor_rows(self.texts), "anchors")
        live = ws.save(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "live")
        at = ws.save(shuffle_join(found, live, "h").groupBy("key").agg(F.collect_list(F.struct("pos", "h")).alias("at")), "positions")
        ws.drop(found, live)
        ws.release()
        wanted = join_ids(self.texts, at.select("key"), ["key"], "left_semi")
        self.occurrences = ws.save(_contexts(shuffle_join(wanted, at, "key").select("key", "text", "at")), "contexts")
        ws.release()
        self.contexts = ws.save(
            self.occurrences.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.max("left").alias("left"), F.max("right").alias("right")), "different")
        # one context that occurs once has no partner
        size = self.contexts.groupBy("h").agg(F.count("*").alias("m"), F.sum("n").alias("n")).filter("n > 1")
        self.size = ws.save(size.select("h", "m"), "sizes")
        ws.release()

    def _chunks(self, whole: bool = False) -> DataFrame:
        """Contexts with a partner, in chunks of about GROUP_ROWS of an anchor
        (``whole``: one chunk), sorted by right context."""
        rows = shuffle_join(self.contexts, self.size, "h")
        chunk = F.lit(0) if whole else F.pmod(F.xxhash64("ctx"), F.ceil(F.col("m") / GROUP_ROWS)).cast("int")
        return (rows.select("h", chunk.alias("chunk"), "ctx", "n", "left", "right")
                .repartition("h", "chunk").sortWithinPartitions("h", "chunk", "right"))

    def cover(self) -> DataFrame:
        """ctx, lo, hi: bytes before and from the anchor that repeats cover."""
        out = self.ws.save(_scan(self._chunks(), groups=False), "cover")
        heavy = self.size.filter(F.col("m") > GROUP_ROWS)
        if heavy.isEmpty():
            return out
        known = shuffle_join(shuffle_join(self.contexts, heavy.select("h"), "h"), out, "ctx", "left").fillna(0, ["lo", "hi"])
        more = _across_chunks(self.ws.save(known.select("h", "ctx", "left", "right", "lo", "hi"), "heavy"))
        return self.ws.save(out.unionByName(more).groupBy("ctx").agg(F.max("lo").cast("int").alias("lo"), F.max("hi").cast("int").alias("hi")), "cover")

    def spans(self) -> DataFrame:
        """key, spans: unmerged [start, end) that repeats cover, of texts that
        are the only one of their class."""
        hit = shuffle_join(self.occurrences.select("key", "pos", "ctx"), self.cover(), "ctx")
        return self.ws.save(hit.select("key", F.struct((F.col("pos") - F.col("lo")).alias("s"), (F.col("pos") + F.col("hi")).alias("e")).alias("x"))
                            .groupBy("key").agg(F.collect_list("x").alias("spans")), "spans")

    def groups(self) -> DataFrame:
        """Maximal repeats around anchors: h, nth (the group), key, start,
        length of every occurrence.  A repeat that holds several anchors, or is
        longer than the contexts, comes out in part around each of them.  All
        different contexts of an anchor (below 2 * WINDOW bytes each) are scanned
        by one task, so that its groups are whole."""
        g = _scan(self._chunks(whole=True), groups=True)
        return shuffle_join(g, self.occurrences.select("key", "pos", "ctx"), "ctx").select(
            "h", "nth", "key", (F.col("pos") - F.col("lo")).alias("start"), (F.col("lo") + F.col("hi")).alias("length"))


def _cut(text: str, spans: list[dict]) -> tuple[bytes, list[bytes], int]:
    """The text's bytes, what stays of them, and the number of removed runs."""
    b, kept, at, runs, end = text.encode(), [], 0, 0, -1
    for x in sorted(spans, key=lambda x: x["s"]):
        if x["s"] > end:
            runs += 1
            kept.append(b[at:x["s"]])
        at = end = max(end, x["e"])
    kept.append(b[at:])
    return b, kept, runs


def _figures(wanted: DataFrame) -> DataFrame:
    """(key, text, spans) -> key, n_removed, n_spans, kept_sha256."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 1 << 20):
                out = []
                for key, t, spans in zip(*(piece.column(c).to_pylist() for c in ("key", "text", "spans"))):
                    b, kept, runs = _cut(t, spans)
                    k = b"".join(kept)
                    out.append((key, len(b) - len(k), runs, hashlib.sha256(k).hexdigest()))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=["key", "n_removed", "n_spans", "kept_sha256"])

    return wanted.mapInArrow(run, "key long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """All rows with their columns; ``text`` without its repeated bytes (a
    character that loses some of its bytes goes whole), ``n_chars`` renewed if
    there is such a column.  Only texts that lose something are moved."""
    r = Repeats(docs)
    names, key, at = docs.columns, fresh(docs, "_key"), fresh(docs, "_spans")
    spans = r.spans().withColumnsRenamed({"key": key, "spans": at})
    whole = r.ws.save(shuffle_join(r.rows.filter(F.col("n_bytes") >= WINDOW), r.classes.select("sha"), "sha").select(F.col("key").alias(key)).distinct(), "whole")
    part = r.ws.save(shuffle_join(spans.select(key), whole, key, "left_anti"), "part")
    tagged = docs.withColumn(key, r.key)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 1 << 20):
                text = []
                for t, s in zip(piece.column("text").to_pylist(), piece.column(at).to_pylist()):
                    text.append("".join(p.decode("utf-8", "ignore") for p in _cut(t, s)[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text, pa.string()) if c == "text" else piece.column(c) for c in names], names=names)

    cut = shuffle_join(join_ids(tagged, part, [key], "left_semi"), spans, key).select(*names, at).mapInArrow(run, docs.schema)
    gone = join_ids(tagged, whole, [key], "left_semi").withColumn("text", F.lit("").cast(docs.schema["text"].dataType))
    same = join_ids(join_ids(tagged, whole, [key], "left_anti"), part, [key], "left_anti")
    changed = cut.unionByName(gone.select(*names))
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return same.select(*names).unionByName(changed.select(*names))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    r = Repeats(docs)
    spans = r.spans()
    cut = _figures(shuffle_join(join_ids(r.texts, spans.select("key"), ["key"], "left_semi"), spans, "key").select("key", "text", "spans"))
    cut = r.ws.save(cut.dropDuplicates(["key"]), "cut")
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= WINDOW)
    empty = hashlib.sha256(b"").hexdigest()
    return (shuffle_join(shuffle_join(r.rows, r.classes.select("sha", "n"), "sha", "left"), cut, "key", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256")))
