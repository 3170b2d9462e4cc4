"""Elias-Fano sequences and an n-gram trie over memory-mapped levels."""

from __future__ import annotations

import os
import tempfile

import numpy as np

_PLACE = np.zeros((256, 8), np.uint8)  # _PLACE[byte, r]: where the byte's r-th one is
for _b in range(256):
    for _r, _k in enumerate([k for k in range(8) if _b >> k & 1]):
        _PLACE[_b, _r] = _k
_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_FIVES, _THREES, _LOWER = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of the ``rank``-th ones (from 0) of 64-bit words. before[k]: ones ahead of word k."""
    at = np.searchsorted(before, rank, "right") - 1
    left, word = (rank - before[at]).astype(np.uint64), words[at]
    # ones up to each byte's end, side by side: ones of two, four and eight bits, then running sums by one product
    ones = word - ((word >> np.uint64(1)) & _FIVES)
    ones = (ones & _THREES) + ((ones >> np.uint64(2)) & _THREES)
    with np.errstate(over="ignore"):
        upto = ((ones + (ones >> np.uint64(4))) & _LOWER) * _EACH
    byte = np.bitwise_count((left * _EACH | _TOP) - upto & _TOP).astype(np.uint64) * np.uint64(8)  # bytes that end before the one
    ahead = ((upto << np.uint64(8)) >> byte) & np.uint64(255)
    return at * 64 + byte.astype(np.int64) + _PLACE[(word >> byte) & np.uint64(255), left - ahead]


class EliasFano:
    """A monotone sequence: ``low`` bits of each value side by side, the rest in unary."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.ones, self.zeros = n, low, lows, highs.view("<u8"), ones, zeros
        self.highs_off = None
        self.eights = np.ndarray(max(len(lows) - 7, 0), "<u8", lows, strides=(1,))

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        low = min(max(0, (universe // max(n, 1)).bit_length() - 1), 56)
        lows = []
        for k in range(0, n, 1 << 16):
            bits = (values[k : k + (1 << 16), None] >> np.arange(low, dtype=np.uint64)).astype(np.uint8) & np.uint8(1)
            lows.append(np.packbits(bits.ravel(), bitorder="little"))
        lows = np.concatenate([*lows, np.zeros(8, np.uint8)])  # room to read eight bytes anywhere
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = int((universe >> low) + n + 1)
        flags = np.zeros(-(-bits // 64) * 64, np.uint8)
        flags[high] = 1
        highs = np.packbits(flags, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(flags.reshape(-1, 64).sum(1, dtype=np.int64))])[:-1]
        zeros = np.arange(len(ones)) * 64 - ones
        return n, low, lows, highs, ones.astype(np.int64), zeros.astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        return (self.eights[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        high = _select(self.highs, self.ones, i) - i
        return (high.astype(np.uint64) << np.uint64(self.low)) | self._lows(i)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successor search: for each value the first position whose value is not less, and whether it is equal."""
        high = (values >> np.uint64(self.low)).astype(np.int64)
        low = values & np.uint64((1 << self.low) - 1)
        if self.highs_off is None:
            self.highs_off = ~np.asarray(self.highs)
        # the bucket of equal upper bits lies between two zeros; its lower bits are in order
        at = np.where(high > 0, _select(self.highs_off, self.zeros, np.maximum(high - 1, 0)) + 1 - high, 0)
        end = _select(self.highs_off, self.zeros, high) - high
        to = end.copy()
        open_ = np.flatnonzero(at < to)
        while len(open_):
            a, b = at[open_], to[open_]
            mid = (a + b) >> 1
            less = self._lows(mid) < low[open_]
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            at[open_], to[open_] = a, b
            open_ = open_[a < b]
        equal = at < end
        equal[equal] = self._lows(at[equal]) == low[equal]
        return at, equal


class Levels:
    """Arrays in one temporary file, mapped and at once unlinked, so nothing stays behind."""

    def __init__(self, arrays: list[np.ndarray]):
        handle, path = tempfile.mkstemp()
        try:
            with os.fdopen(handle, "wb") as file:
                spots = []
                for a in arrays:
                    file.write(b"\0" * (-file.tell() % 8))
                    spots.append((file.tell(), a.dtype, len(a)))
                    file.write(a.tobytes())
                file.write(b"\0" * 8)
            whole = np.memmap(path, np.uint8, "r")
        finally:
            os.unlink(path)
        self.arrays = [whole[at : at + n * kind.itemsize].view(kind) for at, kind, n in spots]


class Successors:
    """One level of a trie: for each context (a place on the level above) a range of successors.

    Successors are kept with their context's base (its place times ``span``) added, so that they
    are monotone, and a search in a context's range is a search for base + successor. Pointers and
    successors are Elias-Fano sequences; ``codes`` holds a value of each successor, ``weights`` one of
    each context.
    """

    def __init__(self, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, weights: np.ndarray, span: int):
        self.pointers, self.successors, self.codes, self.weights, self.span = pointers, successors, codes, weights, span

    def places(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each successor of its context is, and whether it is there at all.

        The context's base confines the search to its range: an equal value can only be one of its own.
        """
        return self.successors.find(context.astype(np.uint64) * np.uint64(self.span) + successor)

    def code(self, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Values at places that were found, else 0."""
        out = np.zeros(len(at), np.uint8)
        out[found] = self.codes[at[found]]
        return out


class Trie:
    """Contexts (sorted keys with counts) and levels of successors below them, in memory-mapped files.

    A level is given as (successors with their base, codes, weights of the contexts, span); what a level holds are the
    next level's contexts.
    """

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]):
        sequences, above = [EliasFano.encode(contexts, 1 << 64)], len(contexts)
        for based, _, _, span in levels:
            pointers = np.searchsorted(based, np.arange(above + 1, dtype=np.uint64) * np.uint64(span))
            sequences += [EliasFano.encode(pointers.astype(np.uint64), len(based) + 1), EliasFano.encode(based, max(1, above * span))]
            above = len(based)
        plain = [x for _, codes, weights, _ in levels for x in (codes, weights)]
        stored = Levels([x for s in sequences for x in s[2:]] + [counts.astype(np.int64), *plain]).arrays
        mapped = [EliasFano(s[0], s[1], *stored[4 * k : 4 * k + 4]) for k, s in enumerate(sequences)]
        self.counts, *plain = stored[4 * len(sequences) :]
        self.contexts = mapped[0]
        self.levels = [Successors(mapped[2 * k + 1], mapped[2 * k + 2], plain[2 * k], plain[2 * k + 1], level[3]) for k, level in enumerate(levels)]

    def context(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each context, and whether it is there."""
        return self.contexts.find(keys)
