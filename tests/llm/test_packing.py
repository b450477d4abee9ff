import collections
import random
import zlib

import numpy as np
import pytest

from demoforge.llm import packing
from demoforge.llm.encode import default_tokenizer
from tests.llm.edge import edge_docs, edge_rows, empty_docs


def verify(histogram, capacity, runs, n_bins):
    bins, count = collections.defaultdict(list), collections.Counter()
    for length, first, n, b, offset, per in runs.tolist():
        assert first == count[length]
        count[length] += n
        for i in range(n):
            bins[b + i // per].append((offset + i % per * length, length))
    assert count == collections.Counter({k: v for k, v in histogram.items() if v})
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == n_bins


def best_fit(histogram, capacity):
    from bisect import bisect_left, insort

    rooms, n = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = bisect_left(rooms, length)
            if k == len(rooms):
                n += 1
                insort(rooms, capacity - length)
            else:
                insort(rooms, rooms.pop(k) - length)
    return n


@pytest.mark.parametrize("seed", range(40))
def test_plan_holds_every_piece_once(seed):
    rng = random.Random(seed)
    h = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
    verify(h, 64, *packing.plan_with(h, 64, rng.randint(2, 9), rng.randint(1, 12)))
    verify(h, 64, *packing.plan(h, 64))


def test_plan_is_close_to_the_lower_bound():
    rng = random.Random(3)
    h = collections.Counter(min(2048, int(rng.lognormvariate(6.5, 1)) + 1) for _ in range(20_000))
    _, n = packing.plan(h, 2048)
    lower = -(-sum(k * v for k, v in h.items()) // 2048)
    assert lower <= n <= min(best_fit(h, 2048) + 5, 1.002 * lower + 1)
    # thirds: a greedy pairing of large ones would waste a third of the room
    assert packing.plan({700: 300, 648: 300}, 2048)[1] <= 200 + 2


def test_empty_plan():
    runs, n = packing.plan({}, 2048)
    assert n == 0 and runs.shape == (0, 6)


def test_pack_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    rows = packing.pack(edge_docs(spark), default_tokenizer(), with_ids=True).collect()
    want = collections.Counter()
    for r in edge_rows():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    room = collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        room[r.sequence_id].append((r.offset, r.length))
    for items in room.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    joined = packing.sequences(spark.createDataFrame(rows)).collect()
    assert sum(len(r.ids) for r in joined) == 4 * sum(r.length for r in rows)


def test_empty_table(spark):
    out = packing.pack(empty_docs(spark), default_tokenizer())
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 0
