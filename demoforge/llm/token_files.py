"""Token files: concatenated ids with Elias-Fano document boundaries.

A token file set is a Parquet folder whose rows are *segments*.  A segment's
``image`` holds, for consecutive documents in ascending doc_id order, the ids
of all of them in one array (2 bytes an id while the vocabulary allows it) and
two Elias-Fano sequences, the document ids and the document boundaries.  A
monotone sequence of n values below u takes about 2 + log2(u / n) bits a value;
``select`` finds value i from sampled positions of set bits, so no table of
64-bit offsets exists.  Parquet is only the container: Spark's committer makes
the files complete or absent when executors are lost, on any file system.

Nulls: a null text is the empty text; rows with a null doc_id come first.
Empty texts hold the end id alone.  Repeated rows are written as often as they
occur, rows of equal doc_id next to each other in any order.  An empty table
gives an empty file set.  A long text is a segment of its own.  Other columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demoforge.llm.encode import PIECE_BYTES, library_encoder, slices

#: a segment is closed when it holds this many ids (a longer document is one segment)
SEGMENT_IDS = 1 << 18
#: distance of sampled set bits in the select structure
SELECT_STEP = 256
MAGIC = b"EFT1"
SEGMENT_SCHEMA = "part int, seq int, part_start long, n_docs int, n_tokens long, image binary"


class EliasFano:
    """A non-decreasing sequence of non-negative integers below 2**63."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        flags[ones] = 1
        return cls(n, bits, low.tobytes(), np.packbits(flags, bitorder="little").tobytes(),
                   ones[::SELECT_STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<IBII", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, bits, n_low, n_high = struct.unpack_from("<IBII", data, at)
        at += 13
        low, high = data[at:at + n_low], data[at + n_low:at + n_low + n_high]
        at += n_low + n_high
        k = -(-n // SELECT_STEP)
        return cls(n, bits, low, high, np.frombuffer(data, "<u4", k, at)), at + 4 * k

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, dtype=np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        raw = np.frombuffer(self.low, dtype=np.uint8, offset=a // 8, count=-(-b // 8) - a // 8)
        bits = np.unpackbits(raw, bitorder="little")[a % 8:a % 8 + b - a].reshape(-1, self.low_bits)
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i, reading from the sample before it up to the next one only."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = i // SELECT_STEP
        first = int(self.samples[k])
        last = int(self.samples[k + 1]) + 1 if k + 1 < len(self.samples) else 8 * len(self.high)
        raw = np.frombuffer(self.high, dtype=np.uint8, offset=first // 8, count=-(-last // 8) - first // 8)
        bits = np.unpackbits(raw, bitorder="little")[first % 8:]
        one = first + int(np.flatnonzero(bits)[i % SELECT_STEP])
        return ((one - i) << self.low_bits) | int(self._low(i, i + 1)[0])

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        return (high | self._low(0, self.n)).astype(np.int64)


class Segment:
    """Read access to one segment image."""

    def __init__(self, image: bytes):
        magic, self.width, self.n_null, self.first_id = struct.unpack_from("<4sBIq", image, 0)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.ids, at = EliasFano.read(image, 17)
        self.bounds, at = EliasFano.read(image, at)
        self.tokens = np.frombuffer(image, f"<u{self.width}", offset=at)

    def __len__(self) -> int:
        return self.bounds.n - 1

    def doc_id(self, k: int) -> int | None:
        return None if k < self.n_null else self.first_id + self.ids.select(k - self.n_null)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, found through two select calls."""
        return self.tokens[self.bounds.select(k):self.bounds.select(k + 1)]


def segment_image(doc_ids: list, tokens: list[bytes], width: int) -> bytes:
    """doc_ids ascending, nulls first; tokens as little-endian uint32 bytes."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    bounds = np.concatenate([[0], np.cumsum([len(t) // 4 for t in tokens])])
    payload = np.frombuffer(b"".join(tokens), "<u4").astype(f"<u{width}")
    return b"".join([
        struct.pack("<4sBIq", MAGIC, width, len(doc_ids) - len(known), first),
        EliasFano.of(np.array([d - first for d in known], dtype=np.uint64)).to_bytes(),
        EliasFano.of(bounds).to_bytes(),
        payload.tobytes(),
    ])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode ``text`` of (doc_id, text) and write segments ordered by doc_id.

    Texts are dealt by ranges of doc_id, each task sorts its range and encodes
    it in pieces; a task holds one piece and one open segment."""

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = library_encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        ids, toks, n = [], [], 0

        def close():
            nonlocal ids, toks, n, seq, start
            # two bytes an id wherever this segment's ids allow it
            width = 2 if max((int(np.frombuffer(t, "<u4").max()) for t in toks), default=0) < 1 << 16 else 4
            row = {"part": [part], "seq": [seq], "part_start": [start], "n_docs": [len(ids)], "n_tokens": [n],
                   "image": [segment_image(ids, toks, width)]}
            seq, start, ids, toks, n = seq + 1, start + n, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int32()),
                ("n_tokens", pa.int64()), ("image", pa.binary())]))

        for batch in batches:
            for piece in slices(batch, PIECE_BYTES):
                for d, t in zip(piece.column("doc_id").to_pylist(), encoder.batch(piece.column("text"))):
                    ids.append(d)
                    toks.append(t + end)
                    n += len(t) // 4 + 1
                    if n >= SEGMENT_IDS:
                        yield close()
        if ids:
            yield close()

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(write, SEGMENT_SCHEMA).write.mode("error").parquet(path))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it in the whole file set),
    n_tokens, ids_crc32 and, ``with_ids``, the ids themselves, as they are in
    the files."""
    schema = "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for part, start, image in zip(*(batch.column(c).to_pylist() for c in ("part", "part_start", "image"))):
                s = Segment(image)
                b = s.bounds.values()
                ids = [None] * s.n_null + (s.first_id + s.ids.values()).tolist()
                toks = [s.tokens[x:y].astype("<u4").tobytes() for x, y in zip(b[:-1], b[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(ids), pa.int32()), pa.array(ids, pa.int64()),
                    pa.array(start + b[:-1], pa.int64()), pa.array(np.diff(b), pa.int64()),
                    pa.array([zlib.crc32(t) for t in toks], pa.int64()), *([pa.array(toks, pa.binary())] * with_ids)],
                    names=[c.split()[0] for c in schema.split(", ")])

    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    rows = files.select("part", "part_start", "image").mapInArrow(read, schema)
    # one row for each writing task
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) AS base")
    return rows.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("base") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
