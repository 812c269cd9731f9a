"""Words of many texts at once: byte tables and 64-bit word hashes over whole slices of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Bytes of terms: ASCII letters and digits and everything outside ASCII; all else separates.
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64), another one for each seed."""
    z = x + np.uint64((seed * int(_GOLDEN) + int(_GOLDEN)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_VALUES = mix(np.arange(256, dtype=np.uint64), 1)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, a line feed after each text, and where each text begins."""
    data = np.frombuffer("\n".join(column.to_pylist()).encode() + b"\n", np.uint8)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return data[: len(data) if len(sizes) else 0], np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)


class Hasher:
    """Polynomial hashes of byte ranges modulo 2^64, by prefix sums: all words of a buffer in a few passes."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                steps = np.full(size, _BASE, np.uint64)
                steps[0] = 1
                self.powers = np.multiply.accumulate(steps)
                steps[1:] = np.uint64(_INVERSE)
                self.inverses = np.multiply.accumulate(steps)

    def ranges(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_VALUES[data] * self.powers[: len(data)], out=sums[1:])
            return mix((sums[ends] - sums[begins]) * self.inverses[begins] + (ends - begins).astype(np.uint64))


HASHER = Hasher()


def words(data: np.ndarray, starts: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words of a buffer, and the text each lies in. The line feed after a text must separate."""
    inside = ~separators[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    begins, ends = edges[::2], edges[1::2]
    return begins, ends, np.searchsorted(starts, begins, "right") - 1


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term hash) pairs of a column, sorted by text and hash; terms are in ASCII lower case."""
    data, starts = joined(column)
    data = LOWER[data]
    begins, ends, owner = words(data, starts, NO_TERM)
    return distinct(owner, HASHER.ranges(data, begins, ends))


def distinct(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[first], hashes[first]
