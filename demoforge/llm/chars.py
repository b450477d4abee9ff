"""Character n-grams inside words, hashed to slots, for whole word lists."""

from __future__ import annotations

import numpy as np

START, END = "\x01", "\x02"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def framed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all framed words after each other, and each word's start."""
    frames = [START + w + END for w in words]
    size = np.array([len(f) for f in frames], dtype=np.int64)
    data = np.frombuffer("".join(frames).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return data.astype(np.uint64), np.cumsum(size) - size


def gram_hashes(data: np.ndarray, start: np.ndarray, order: int) -> np.ndarray:
    """For each place: a hash of the ``order`` code points that end there, cut
    at the word's start."""
    own = np.zeros(len(data), dtype=np.int64)
    own[start] = start
    own = np.maximum.accumulate(own)
    back = np.arange(len(data)) - own
    h = np.zeros(len(data), dtype=np.uint64)
    for j in range(min(order, len(data))):
        x = np.zeros(len(data), dtype=np.uint64)
        x[j:] = (data[: len(data) - j] + np.uint64(1)) * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1)
        h += np.where(back >= j, x, np.uint64(0))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordTable:
    """A memo of rows of numbers for words, restarted when it is full."""

    LIMIT = 200_000

    def __init__(self, compute, width: int):
        self.compute, self.width = compute, width
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, width))

    def batch(self, lists: list[list[str]]) -> list[np.ndarray]:
        """Row numbers of each list's words (valid until the next call)."""
        new = list({w for words in lists for w in words if w not in self.place})
        if len(self.place) + len(new) > self.LIMIT and self.place:
            self.place, self.rows = {}, np.zeros((0, self.width))
            new = list({w for words in lists for w in words})
        if new:
            self.place.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, self.compute(new)])
        get = self.place.__getitem__
        return [np.fromiter(map(get, words), dtype=np.int64, count=len(words)) for words in lists]
