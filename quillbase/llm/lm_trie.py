"""An n-gram trie in flat buffers: Elias-Fano levels, monotone pointers, quantised probabilities.

A level keeps, for each context, its successors in ascending order. To make the whole level one monotone
sequence, every successor is kept relative to its context: the last value of the context before it is
added. A sequence of n values below u takes about log2(u / n) + 2 bits each: low bits packed, high bits in
unary. All parts are one buffer that numpy reads in place, so a file's memory map or a column's value
serves as it is, and only the slabs that queries touch are decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Values of a block, of which the first is kept plain to be searched, and blocks that are decoded at once.
BLOCK, SLAB_BLOCKS = 512, 512
#: Probabilities are kept as their base-10 logarithm in steps of 1 / STEPS; code 0 stands for "not there".
STEPS, ABSENT = 256, 0
_HEAD = "<QQB7xQQQ"


def runs(labels: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal labels, which aren't negative."""
    edges = np.append(np.flatnonzero(np.diff(labels, prepend=-1)), len(labels)).tolist()
    return zip(edges[:-1], edges[1:], strict=True)


def quantise(values: np.ndarray) -> np.ndarray:
    """Codes of numbers in (0, 1]; 0 for 0."""
    with np.errstate(divide="ignore"):
        logs = np.log10(values)
    return np.where(values > 0, np.clip(1 + np.rint(-logs * STEPS), 1, 65535), ABSENT).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    """The numbers that codes stand for."""
    return _RESTORED[codes]


_RESTORED = 10.0 ** (-(np.arange(65536) - 1.0) / STEPS)
_RESTORED[ABSENT] = 0.0


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, one after the other."""
    if not width or not len(values):
        return np.empty(0, dtype=np.uint8)
    out = []
    step = 1 << 17  # a multiple of 8 values ends on a whole byte
    for a in range(0, len(values), step):
        bits = (values[a : a + step, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate(out)


def _unpack_bits(packed: np.ndarray, width: int, a: int, b: int) -> np.ndarray:
    """Values a to b of ``_pack_bits``."""
    if not width:
        return np.zeros(b - a, dtype=np.uint64)
    first, last = a * width, b * width
    bits = np.unpackbits(packed[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 : first % 8 + last - first]
    return bits.reshape(-1, width).astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))


@dataclass
class EliasFano:
    """A monotone sequence of ``n`` values up to ``top``, read in place."""

    n: int
    top: int
    width: int
    heads: np.ndarray
    #: Bit of ``high`` at which each block begins.
    begins: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def packed(values: np.ndarray) -> bytes:
        """The sequence as bytes, a multiple of eight."""
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones.astype(np.int64)] = 1
        high, low = np.packbits(high, bitorder="little"), _pack_bits(values & np.uint64((1 << width) - 1), width)
        parts = [struct.pack(_HEAD, n, top, width, len(values[::BLOCK]), len(low), len(high)), values[::BLOCK].tobytes(), ones[::BLOCK].tobytes(), low.tobytes(), high.tobytes()]
        joined = b"".join(parts)
        return joined + bytes(-len(joined) % 8)

    @staticmethod
    def read(buffer: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence that begins at byte ``at``, and the byte after it."""
        n, top, width, blocks, low, high = struct.unpack_from(_HEAD, buffer, at)
        view = lambda start, kind, count: np.frombuffer(buffer, dtype=kind, count=count, offset=start) if count else np.empty(0, kind)
        a = at + struct.calcsize(_HEAD)
        heads, begins = view(a, np.uint64, blocks), view(a + 8 * blocks, np.uint64, blocks)
        a += 16 * blocks
        end = a + low + high
        return EliasFano(n, top, width, heads, begins, view(a, np.uint8, low), view(a + low, np.uint8, high)), end + (at - end) % 8

    def decode(self, first: int, last: int) -> np.ndarray:
        """Values of the blocks ``first`` to ``last``, the last one not included."""
        a, b = first * BLOCK, min(last * BLOCK, self.n)
        start = int(self.begins[first])
        stop = int(self.begins[last]) if last < len(self.begins) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8 : (stop + 7) // 8], bitorder="little")
        ones = np.flatnonzero(bits[start % 8 : start % 8 + stop - start])[: b - a] + start
        high = ones.astype(np.uint64) - np.arange(a, b, dtype=np.uint64)
        return (high << np.uint64(self.width)) | _unpack_bits(self.low, self.width, a, b)

    def values(self) -> np.ndarray:
        """All values."""
        return self.decode(0, len(self.heads)) if self.n else np.empty(0, dtype=np.uint64)

    def access(self, places: np.ndarray) -> np.ndarray:
        """The values at ascending ``places``."""
        out = np.empty(len(places), dtype=np.uint64)
        for a, b in runs(places // (BLOCK * SLAB_BLOCKS)):
            first = int(places[a]) // BLOCK
            part = self.decode(first, min(int(places[b - 1]) // BLOCK + 1, len(self.heads)))
            out[a:b] = part[places[a:b] - first * BLOCK]
        return out

    def successors(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the ascending ``wanted``: the place of the first value that isn't less, and whether it equals it."""
        if not self.n:
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        place, equal = np.empty(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        block = np.maximum(np.searchsorted(self.heads, wanted, side="left") - 1, 0)
        for a, b in runs(block // SLAB_BLOCKS):
            first, last = int(block[a]), min(int(block[b - 1]) + 2, len(self.heads))  # a successor may head the next block
            part = self.decode(first, last)
            at = np.searchsorted(part, wanted[a:b], side="left")
            place[a:b] = first * BLOCK + at
            equal[a:b] = part[np.minimum(at, len(part) - 1)] == wanted[a:b]
        return place, equal


def relative(contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """One monotone sequence of the successors of ascending contexts 0, 1, ...: each is counted from the last value of the context before."""
    ends = np.append(np.flatnonzero(np.diff(contexts)), len(contexts) - 1) if len(contexts) else np.empty(0, dtype=np.int64)
    base = np.concatenate(([0], np.cumsum(successors[ends].astype(np.uint64) + np.uint64(1))))[:-1] if len(ends) else np.empty(0)
    return successors.astype(np.uint64) + np.repeat(base.astype(np.uint64), np.diff(np.concatenate(([-1], ends))))


class Trie:
    """Levels of a trie over word numbers: contexts, their successors, and codes of both."""

    def __init__(self, buffer) -> None:
        view = memoryview(buffer)
        self.words, at = EliasFano.read(view, 0)
        self.pointers, at = EliasFano.read(view, at)
        self.level, at = EliasFano.read(view, at)
        self.rest = np.frombuffer(view, dtype=np.uint16, count=self.words.n, offset=at)
        self.shares = np.frombuffer(view, dtype=np.uint16, count=self.level.n, offset=at + 2 * self.words.n)

    @staticmethod
    def build(first: np.ndarray, second: np.ndarray, shares: np.ndarray, contexts: np.ndarray, rest: np.ndarray) -> bytes:
        """Pairs in ascending order with the discounted share of each, and the ascending contexts, each with what it leaves to lower orders."""
        numbers = np.searchsorted(contexts, first)
        pointers = np.searchsorted(first, contexts, side="left")
        levels = (EliasFano.packed(x) for x in (contexts, np.append(pointers, len(first)), relative(numbers, second)))
        return b"".join([*levels, quantise(rest).tobytes(), quantise(shares).tobytes()])

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share code of the pair, rest code of its context) of pairs in ascending order; 0 where there is none."""
        shares, rest = np.zeros(len(first), dtype=np.uint16), np.zeros(len(first), dtype=np.uint16)
        asked, number = np.unique(first, return_inverse=True)
        place, known = self.words.successors(asked.astype(np.uint64))
        found = place[known]
        if not len(found):
            return shares, rest
        begin, end = (np.zeros(len(asked), dtype=np.int64) for _ in "be")
        begin[known] = self.pointers.access(found)
        end[known] = self.pointers.access(found + 1)
        base = np.zeros(len(asked), dtype=np.uint64)
        later = known & (begin > 0)
        base[later] = self.level.access(begin[later] - 1) + np.uint64(1)
        own = np.zeros(len(asked), dtype=np.uint16)
        own[known] = self.rest[found]
        rest = own[number]
        # beyond a context's last successor the search would go on in the next context
        ask = np.flatnonzero(known[number])
        wanted = base[number[ask]] + second[ask].astype(np.uint64)
        order = np.argsort(wanted, kind="stable")
        place, equal = self.level.successors(wanted[order])
        hit = equal & (place < end[number[ask[order]]])
        shares[ask[order[hit]]] = self.shares[place[hit]]
        return shares, rest
