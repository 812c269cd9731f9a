"""Ranges of a buffer numbered exactly by their content, and ids gathered from flat buffers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

from pricewarden.llm.words import HASHER

PART_BYTES = 1 << 20  # bytes numbered or compared at a time, so that a long text takes no more room than a short one
MEMO_PIECES = 400_000  # distinct pieces a worker remembers
MEMO_IDS = 4_000_000  # ids it remembers for them

def positions(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of all ranges, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


def parts(begins: np.ndarray, ends: np.ndarray, limit: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of ranges that together reach over about `limit` bytes; a longer range is a run of its own."""
    a = 0
    while a < len(begins):
        b = max(a + 1, int(np.searchsorted(ends, begins[a] + limit, "right")))
        yield a, b
        a = b


def numbered(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): the first range of each distinct content, and the number of every range's content.

    Contents meet by a 64-bit hash and are then compared byte by byte; should two contents ever share a hash, they are told
    apart by themselves.
    """
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = [HASHER.ranges(data[begins[a] : ends[b - 1]], begins[a:b] - begins[a], ends[a:b] - begins[a]) for a, b in parts(begins, ends)]
    _, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    sizes, model = ends - begins, begins[first][which]
    same = bool((sizes == sizes[first][which]).all())
    for a, b in parts(begins, ends, PART_BYTES // 4) if same else ():
        at = positions(begins[a:b], sizes[a:b])
        same = same and bool((data[at] == data[at + np.repeat(model[a:b] - begins[a:b], sizes[a:b])]).all())
    if same:
        return first, which
    known: dict[bytes, int] = {}
    raw, first, which = data.tobytes(), [], np.zeros(len(begins), np.int64)
    for i, (x, y) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        which[i] = known.setdefault(raw[x:y], len(known))
        if which[i] == len(first):
            first.append(i)
    return np.array(first, np.int64), which


def flattened(lists: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one buffer, and their lengths."""
    lists = list(lists)
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())), counts


def id_bytes(table: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids as one buffer, where those of each begin, and how many they are."""
    sizes = np.array([len(b) for b in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes


class FlatMemo:
    """Ids per distinct piece in one flat buffer. Forgets everything once it holds too much, so memory stays bounded."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.start = self.count = np.zeros(0, np.int64)
        self.good = np.zeros(0, bool)

    def compute(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A buffer of ids; for each piece where its ids begin, how many they are, and whether they stand for exactly its bytes."""
        raise NotImplementedError

    def _learn(self, pieces: list[bytes]) -> None:
        fresh, start, count, good = self.compute(pieces)
        self.start = np.concatenate([self.start, len(self.flat) + start])
        self.count = np.concatenate([self.count, count])
        self.good = np.concatenate([self.good, good])
        self.flat = np.concatenate([self.flat, fresh])
        self.index.update(zip(pieces, range(len(self.index), len(self.index) + len(pieces)), strict=True))

    def encode(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in order, how many each piece has, and whether they stand for its bytes."""
        out: list[tuple] = [(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool))]
        for a, b in parts(begins, ends):
            base = int(begins[a])
            own = data[base : int(ends[b - 1])]
            first, which = numbered(own, begins[a:b] - base, ends[a:b] - base)
            raw = own.tobytes()
            keys = [raw[x:y] for x, y in zip((begins[a:b][first] - base).tolist(), (ends[a:b][first] - base).tolist(), strict=True)]
            if len(self.index) + len(keys) > MEMO_PIECES or len(self.flat) > MEMO_IDS:
                fresh = [k for k in keys if k not in self.index]
                if len(self.index) + len(fresh) > MEMO_PIECES or len(self.flat) > MEMO_IDS:
                    self.clear()
            missing = [k for k in keys if k not in self.index]
            if missing:
                self._learn(missing)
            row = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[which]
            counts = self.count[row]
            out.append((self.flat[positions(self.start[row], counts)], counts, self.good[row]))
        ids, counts, good = (np.concatenate(c) for c in zip(*out, strict=True))
        return ids, counts, good


def same_bytes(pieces: list[bytes], ids: np.ndarray, start: np.ndarray, count: np.ndarray, table: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ids of each piece stand for exactly its bytes."""
    own = ids[positions(start, count)]
    of = np.repeat(np.arange(len(pieces)), count)
    wanted = np.array([len(p) for p in pieces], np.int64)
    good = np.bincount(of, sizes[own], len(pieces)).astype(np.int64) == wanted
    fits = good[of]
    given = table[positions(begin[own[fits]], sizes[own[fits]])]
    expected = np.frombuffer(b"".join(p for p, g in zip(pieces, good.tolist(), strict=True) if g), np.uint8)
    wrong = given != expected
    if wrong.any():
        good[np.unique(np.repeat(np.flatnonzero(good), wanted[good])[wrong])] = False
    return good
