"""Exact duplicates against an immutable snapshot with binary-fuse filters.

A snapshot holds one entry per different normalised text (digest, largest
doc_id, rows), dealt into buckets by digest; each bucket has one static
three-wise binary-fuse filter (about nine bits an entry, one false positive in
256).  A new batch is grouped by itself; its digests are screened by their
bucket's filter and only positives are joined with the snapshot's exact
entries.  Texts of equal digest are then compared byte for byte, as the least
and greatest text of each digest, which combines before the shuffle; should a
digest ever stand for two texts, its rows are grouped by the texts themselves.

Normalised: null is the empty text, A-Z are lower-cased, nothing else changes.
Of equal texts the row with the largest doc_id stays; a null doc_id is smaller
than any other.  Rows that repeat a doc_id and its text count in group_size and
are all marked kept if theirs is the largest id; ``dedup`` returns them once.
An empty table gives an empty result.  Texts are compared whole, whatever their
length.  Other columns are ignored by ``groups`` and carried by ``dedup``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoforge.llm.common import Workspace, ascii_lower, fresh, join_ids

#: entries of a bucket on average, which bounds a filter's memory
BUCKET_ENTRIES = 16_384
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class BinaryFuse:
    """Static three-wise binary-fuse filter with 8-bit fingerprints."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
        h = keys + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * _M1
        h = (h ^ (h >> np.uint64(33))) * _M2
        return h ^ (h >> np.uint64(33))

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three places in consecutive segments, one row per key."""
        span = np.uint64(segments * segment)
        first = ((h >> np.uint64(32)) * span) >> np.uint64(32)
        mask, size = np.uint64(segment - 1), np.uint64(segment)
        second = (first + size) ^ ((h >> np.uint64(18)) & mask)
        third = (first + size + size) ^ (h & mask)
        return np.stack([first, second, third], axis=1).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def of(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        segments = max(1, -(-int(max(n, 1) * factor) // segment) - 2) + 2
        size = (segments + 2) * segment
        for seed in range(1, 1000):
            h = cls._mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            slots = cls._slots(h, segment, segments)
            # peel all places with one key at once; keys of one round never share their own place
            count = np.bincount(slots.ravel(), minlength=size)
            which = np.zeros(size, dtype=np.int64)
            for c in range(3):
                np.bitwise_xor.at(which, slots[:, c], np.arange(n))
            rounds, left = [], n
            while left:
                lone = np.flatnonzero(count == 1)
                if not len(lone):
                    break
                key, at = np.unique(which[lone], return_index=True)
                rounds.append((key, lone[at]))
                left -= len(key)
                for c in range(3):
                    np.subtract.at(count, slots[key, c], 1)
                    np.bitwise_xor.at(which, slots[key, c], key)
            if left:
                continue
            table, prints = np.zeros(size, dtype=np.uint8), cls._print(h)
            for key, place in reversed(rounds):
                table[place] = 0
                t = table[slots[key]]
                table[place] = prints[key] ^ t[:, 0] ^ t[:, 1] ^ t[:, 2]
            return cls(seed, segment, segments, table)
        raise RuntimeError("no filter found")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = self._mix(np.asarray(keys, dtype=np.uint64), self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        t = self.table[self._slots(h, self.segment, self.segments)]
        return self._print(h) == t[:, 0] ^ t[:, 1] ^ t[:, 2]

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], dtype="<u4").tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse:
        seed, segment, segments = np.frombuffer(data, "<u4", 3).tolist()
        return cls(seed, segment, segments, np.frombuffer(data, np.uint8, offset=12))


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _entries(digests: DataFrame, buckets: int) -> DataFrame:
    return (digests.groupBy("digest").agg(F.max("doc_id").alias("max_id"), F.count("*").alias("n"))
            .withColumn("key", F.xxhash64("digest"))
            .withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")))


def snapshot(ws: Workspace, digests: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, digest) -> exact entries, one filter per bucket, bucket count."""
    buckets = max(64, -(-digests.count() // BUCKET_ENTRIES))
    entries = ws.save(_entries(digests, buckets), "entries")

    def build(pdf):
        import pandas as pd

        keys = pdf["key"].to_numpy().view(np.uint64)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "filter": [BinaryFuse.of(keys).to_bytes()]})

    filters = ws.save(entries.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket int, filter binary"), "filters")
    return entries, filters, buckets


def screened(ws: Workspace, batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The batch's own groups with ``maybe``: can the snapshot hold the digest?"""

    def probe(new, old):
        keys = new["key"].to_numpy().view(np.uint64)
        hit = BinaryFuse.from_bytes(old["filter"].iloc[0]).contains(keys) if len(old) else np.zeros(len(new), bool)
        return new[["digest", "max_id", "n"]].assign(maybe=hit)

    return ws.save(
        _entries(batch, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket"))
        .applyInPandas(probe, "digest binary, max_id long, n long, maybe boolean"), "screened")


def groups(docs: DataFrame, in_snapshot: Column | None = None, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    ``in_snapshot`` marks the rows of the immutable snapshot (default: a hash
    bit of doc_id); the others are the new batch."""
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    if in_snapshot is None:
        in_snapshot = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    text = normalised(F.col("text"))
    one = digest is sha256
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"),
                    *([] if one else [sha256(text).alias("sha")]), F.coalesce(in_snapshot, F.lit(True)).alias("old"))
    d = ws.save(d, "digests")
    entries, filters, buckets = snapshot(ws, d.filter("old").select("doc_id", "digest"))
    new = screened(ws, d.filter("not old").select("doc_id", "digest"), filters, buckets)
    # positives meet the exact entries; the rest of both sides stands alone
    both = ws.save(new.filter("maybe").join(entries.select("digest", F.col("max_id").alias("old_id"), F.col("n").alias("old_n")), "digest")
                   .select("digest", F.greatest("max_id", "old_id").alias("keep_id"), (F.col("n") + F.col("old_n")).alias("size")), "both")
    alone = entries.select("digest", "max_id", "n").unionByName(new.drop("maybe")).filter("n > 1")
    multi = ws.save(both.unionByName(
        alone.join(both.select("digest"), "digest", "left_anti").select("digest", F.col("max_id").alias("keep_id"), F.col("n").alias("size"))), "groups")
    # byte check: the least and the greatest text of a digest are the same
    dup = ws.save(multi.select(F.xxhash64("digest").alias("k")), "dup")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("norm")).withColumn("digest", digest(F.col("norm")))
    rows = join_ids(rows.withColumn("k", F.xxhash64("digest")), dup, ["k"], "left_semi")
    bad = ws.save(rows.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select("digest"), "unequal")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    sha = F.lower(F.hex("digest" if one else "sha"))
    out = (d.join(bad, "digest", "left_anti") if bad.count() else d).join(multi, "digest", "left").select(
        "doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), sha.alias("text_sha256")).withColumn("kept", kept)
    if bad.count():
        r = ws.save(rows.join(bad, "digest", "left_semi").select("doc_id", "norm"), "collided")
        g = ws.save(r.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "by-text")
        out = out.select(*cols).unionByName(
            r.join(g, "norm").withColumn("kept", kept).withColumn("text_sha256", F.sha2("norm", 256)).select(*cols))
    return out.select(*cols)


def dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; rows that repeat a doc_id
    and its text stay once."""
    ws = Workspace(docs.sparkSession, "exact-dedup")
    g = ws.save(groups(docs).select("doc_id", "kept", "text_sha256"), "decisions")
    out = join_ids(docs, ws.save(g.filter("not kept").select("doc_id").distinct(), "dropped"), ["doc_id"], "left_anti")
    # null and repeated ids are settled by id and text together
    odd = ws.save(g.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select("doc_id"), "repeated")
    if odd.isEmpty():
        return out
    i, z, t = (fresh(docs, n) for n in ("_id", "_null", "_sha"))

    def tagged(df, sha):
        return df.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), z: F.col("doc_id").isNull(), t: sha})

    keep = tagged(g.filter("kept"), F.col("text_sha256")).select(i, z, t).distinct()
    own = tagged(odd, F.lit("")).select(i, z)
    many = (tagged(docs, F.sha2(normalised(F.col("text")), 256)).join(own, [i, z], "left_semi")
            .join(keep, [i, z, t], "left_semi").dropDuplicates([i, z, t]).drop(i, z, t))
    return join_ids(out.filter(F.col("doc_id").isNotNull()), odd, ["doc_id"], "left_anti").unionByName(many)
