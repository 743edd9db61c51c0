"""Names for substrings, and chains of windows that share a rare gram.

A name stands for a string of symbols (bytes or words).  Names of length 2h come from two names of length h, of
the string's start and of its later offset h, as in bucket-pointer refinement and prefix doubling; being hashes
rather than ranks they are equal across tasks without exchange.

A window is a string of a fixed length.  Of the grams inside it the one with the smallest name is its bucket, so
equal windows have equal buckets wherever they are.  Neighbouring windows mostly share it: a chain is a run of
windows with one bucket, and chains are what is shuffled, about 2 / (length - gram + 2) of all positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Windows that one step of numpy calls works on.
BLOCK = 1 << 20
#: A place in a document is start and number of windows in one integer that sorts in this order.
_COUNT_BITS = 7


def scramble(values: np.ndarray) -> np.ndarray:
    """64 well-mixed bits for each integer."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_NAMES = scramble(np.arange(1, 257))
_FACTORS = scramble(np.arange(1000, 2024)) | np.uint64(1)


def combine(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Names of the strings that start as ``a`` says and go on as ``b`` says."""
    x = a * _FACTORS[2 * level]
    x += b * _FACTORS[2 * level + 1]
    x ^= x >> np.uint64(29)
    return x


def names(symbols: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Names of all substrings of each length, ascending lengths; entry i is that of the string from i on."""
    out, current, h, level = [], symbols, 1, 0
    for length in lengths:
        while 2 * h <= length:
            current = combine(current[:-h], current[h:], level) if len(current) > h else current[:0]
            h, level = 2 * h, level + 1
        rest = length - h
        if rest == 0:
            out.append(current)
        else:
            out.append(combine(current[:-rest], current[rest:], 100 + length) if len(current) > rest else current[:0])
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    h = 1
    while 2 * h <= width:
        values = np.minimum(values[:-h], values[h:])
        h *= 2
    rest = width - h
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def pack(start: np.ndarray, count: np.ndarray | int) -> np.ndarray:
    return (start.astype(np.int64) << _COUNT_BITS) + count


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start, number of windows."""
    return at >> _COUNT_BITS, at & ((1 << _COUNT_BITS) - 1)


@dataclass(frozen=True)
class Chains:
    """Chains of windows, in order."""

    doc: np.ndarray  # number of the document among those given
    start: np.ndarray  # of the first window, in its document
    count: np.ndarray  # of windows
    bucket: np.ndarray
    path: np.ndarray  # name of the chain's whole string, never 0
    periodic: np.ndarray  # whether windows inside the chain may be equal


@dataclass(frozen=True)
class Windows:
    length: int
    gram: int
    #: Windows in a chain at most; not above ``length``, so that its first and last window cover the chain.
    most: int

    def chains(self, symbols: np.ndarray, sizes: np.ndarray) -> Iterator[Chains]:
        """Chains of documents whose symbols stand one after the other; none reaches across two documents.

        Where a very long input is cut into blocks a chain ends too; that costs work later on, not results.
        """
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        for low in range(0, max(len(symbols) - self.length + 1, 0), BLOCK):
            block = symbols[low : low + BLOCK + self.length - 1]
            yield from self._block(block, low, owner[low : low + len(block)], ends - sizes)

    def _block(self, symbols, low, owner, begins) -> Iterator[Chains]:
        grams, whole = names(symbols, self.gram, self.length)
        bucket = sliding_least(grams, self.length - self.gram + 1)
        place = np.arange(low, low + len(whole))
        doc = owner[: len(whole)]
        inside = doc == owner[self.length - 1 :]
        new = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(inside & np.concatenate(([True], new | ~inside[:-1])))
        last = np.flatnonzero(inside & np.concatenate((new | ~inside[1:], [True])))
        if not len(first):
            return
        parts = -(-(last - first + 1) // self.most)
        if parts.max() > 1:
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, last = np.repeat(first, parts) + nth * self.most, np.repeat(last, parts)
            last = np.minimum(last, first + self.most - 1)
        count = last - first + 1
        path = combine(whole[first], whole[last], 300) * _FACTORS[900] + count.astype(np.uint64) * _FACTORS[901]
        path = (path ^ (path >> np.uint64(31))) | np.uint64(1)
        # equal windows at a distance below ``most`` make a period: a window between them starts with the bucket's
        # gram, and the next window has that gram again
        again = np.concatenate(([0], np.cumsum((grams[: len(bucket) - 1] == bucket[:-1]) & (bucket[1:] == bucket[:-1]))))
        periodic = again[last] > again[first]
        yield Chains(doc[first], place[first] - begins[doc[first]], count, bucket[first], path, periodic)

    def window_names(self, symbols: np.ndarray) -> np.ndarray:
        return names(symbols, self.length)[0]


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entry and length of every run of consecutive integers in a sorted array."""
    if not len(places):
        return places, places
    first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1] + 1)))
    return first, np.diff(np.append(first, len(places)))


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` symbols lie in a span."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(ends, size), -1)
    return np.cumsum(steps[:-1]) > 0
