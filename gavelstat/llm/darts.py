"""Weighted MinHash by throwing darts.

Every element owns a strip, as wide as its weight, of a plane whose other axis is the rank.  Darts fall on the
whole plane at rate one, at places fixed by hashes, so that all sets see the same darts.  A set keeps those that
land on its strips; each dart names one of ``size`` coordinates, and a coordinate keeps its earliest dart.  Two
sets agree in a coordinate with the probability of their weighted Jaccard similarity.  Only darts up to a rank
that fills all coordinates are thrown, about size * log(size) for a set of any size.

Strips are cut into regions [0, 1), [1, 2), [2, 4), [4, 8) ... of the weight axis, each with darts of its own;
a region reaching beyond the weight keeps the darts below it.
"""

from __future__ import annotations

import numpy as np

from gavelstat.llm.windows import scramble

_UNIT = 2.0**-53


def signatures(sets: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, size: int) -> np.ndarray:
    """The name of the earliest dart of each coordinate for ``n`` sets, (n, size); rows of empty sets are zero.

    ``elements`` are 64-bit names, ``sets`` says whose they are (0 to n - 1).
    """
    out = np.zeros((n, size), np.uint64)
    total = np.bincount(sets, weights, n)
    reach = (size * np.log(size) + 2 * size) / np.maximum(total, 1e-300)
    owner, seed, low, width, weight = regions(sets, elements, weights)
    open_ = total > 0
    while open_.any():
        some = open_[owner]
        best, name = _earliest(*(x[some] for x in (owner, seed, low, width, weight)), reach, n, size)
        full = open_ & ~np.isinf(best).any(axis=1)
        out[full] = name[full]
        open_ &= ~full  # a coordinate that no dart has reached: throw further
        reach = reach * 2
    return out


def regions(sets: np.ndarray, elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Set, seed, lower edge, width and element's weight of every region that an element touches."""
    parts = [(sets, scramble(elements), np.zeros(len(elements)), np.ones(len(elements)), weights)]
    low, level = 1.0, 1
    while True:
        more = weights > low
        if not more.any():
            break
        n = int(more.sum())
        seeds = scramble(scramble(elements[more]) + np.uint64(level))
        parts.append((sets[more], seeds, np.full(n, low), np.full(n, low), weights[more]))
        low, level = 2 * low, level + 1
    return tuple(np.concatenate(p) for p in zip(*parts))


def _earliest(owner, seed, low, width, weight, reach, n, size):
    """Rank and name of the earliest dart per set and coordinate, among those with a rank below ``reach``."""
    best = np.full(n * size, np.inf)
    name = np.zeros(n * size, np.uint64)
    rank = np.zeros(len(seed))
    limit = reach[owner]
    while len(seed):
        # two numbers for the throw: the gap to the one before, and the place in the region with the dart's name
        seed = scramble(seed)
        rank = rank - np.log(((seed >> np.uint64(11)).astype(np.float64) + 1) * _UNIT) / width
        near = np.flatnonzero(rank < limit)
        owner, seed, rank, limit, low, width, weight = (x[near] for x in (owner, seed, rank, limit, low, width, weight))
        place = scramble(seed ^ np.uint64(0x5851F42D4C957F2D))
        hit = low + (place >> np.uint64(11)).astype(np.float64) * _UNIT * width < weight
        dart = scramble(place[hit])
        slot = owner[hit] * size + (dart % np.uint64(size)).astype(np.int64)
        at = rank[hit]
        np.minimum.at(best, slot, at)
        first = at == best[slot]
        name[slot[first]] = dart[first]
    return best.reshape(n, size), name.reshape(n, size)
