"""Words of a batch of texts as 64-bit numbers, in numpy over the Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_MARK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])  # space, controls and ASCII punctuation
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


PLACES = 256  # bytes of a word whose random numbers are held in a table; those of later bytes are worked out


class Family:
    """Hash functions of byte strings and of sequences of numbers, set by a seed.

    Every byte at every place of a word has a random number of its own, and so has every place of a window a factor. Equal
    sums of different words are a matter of chance (2^-64), whatever the words look like; powers of a base would let
    regular words meet under every seed.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.seed = seed
        self.byte_at = rng.integers(0, 1 << 64, PLACES * 256, dtype=np.uint64)
        self.far, self.size = rng.integers(0, 1 << 64, 2, dtype=np.uint64) | U(1)
        self.factors = rng.integers(0, 1 << 64, 64, dtype=np.uint64) | U(1)

    def __reduce__(self):
        return Family, (self.seed,)  # the tables are drawn again where they are used

    def factors_to(self, n: int) -> np.ndarray:
        if len(self.factors) < n:
            more = np.random.default_rng((self.seed, n)).integers(0, 1 << 64, n, dtype=np.uint64) | U(1)
            more[: len(self.factors)] = self.factors
            return more
        return self.factors[:n]

    def terms(self, chars: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The numbers of bytes at their places."""
        if not len(place) or int(place.max()) < PLACES:
            return self.byte_at[(place << 8) | chars]
        out = np.empty(len(chars), U)
        near = place < PLACES
        out[near] = self.byte_at[place[near] * 256 + chars[near]]
        out[~near] = mix(mix(place[~near].astype(U) * self.far + self.size) ^ self.byte_at[chars[~near]])
        return out

    def windows(self, x: np.ndarray, size: int) -> np.ndarray:
        """One number for every ``size`` neighbours in a row of numbers (len(x) - size + 1 of them)."""
        if len(x) < size:
            return np.zeros(0, U)
        out = np.zeros(len(x) - size + 1, U)
        for j, f in enumerate(self.factors_to(size)):
            out += x[j : j + len(out)] * f
        return mix(out)


class Words:
    """Where the words of each text are: byte ranges over the joined bytes, and ``first`` word number per text."""

    def __init__(self, column: pa.Array, separators: np.ndarray = IS_SPACE):
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.raw, self.at = raw[at[0] : at[-1]], at - at[0]
        inside = ~separators[self.raw]
        edge = np.zeros(len(self.raw) + 1, bool)
        edge[self.at] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(inside) else inside
        self.start = np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(inside) else inside
        self.end = np.flatnonzero(inside & ~after) + 1
        self.inside = inside
        self.first = np.searchsorted(self.start, self.at)

    def __len__(self) -> int:
        return len(self.at) - 1

    def numbers(self, family: Family, lower: bool = False, only: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit number per word, or per word that the mask ``only`` names."""
        size = self.end - self.start
        chars = self.raw[self.inside]
        if only is not None:
            size, chars = size[only], chars[np.repeat(only, size)]
        if not len(size):
            return np.zeros(0, U)
        begin = np.cumsum(size) - size
        kind = np.int32 if len(chars) < 1 << 31 else np.int64
        place = np.arange(len(chars), dtype=kind) - np.repeat(begin.astype(kind), size)
        terms = family.terms(LOWER[chars] if lower else chars, place)
        return mix(np.add.reduceat(terms, begin) + size.astype(U) * family.size)
