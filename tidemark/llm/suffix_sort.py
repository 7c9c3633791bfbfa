"""Two-stage suffix sorting in numpy, as far as a given depth.

A suffix is rising if it is smaller than its successor, else falling. Only rising suffixes are sorted directly, by their
bytes; falling ones are induced: scanning the order from its start, the predecessor of each suffix met takes the next
free place of its first byte, because removing the first byte of two falling suffixes leaves two in known order.
"""

from __future__ import annotations

import numpy as np


def eight_bytes(text: np.ndarray, beyond: int) -> np.ndarray:
    """Big-endian numbers of the eight bytes from each place on; zeros follow the text."""
    x = np.concatenate((text, np.zeros(beyond + 8, np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    return x


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last is not."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    at = np.searchsorted(change, np.arange(n))
    known = at < len(change)
    j = change[np.minimum(at, max(len(change) - 1, 0))] if len(change) else np.zeros(n, np.int64)
    return known & (text[j] < text[np.minimum(j + 1, n - 1)])


def _sorted_directly(places: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the ``depth`` bytes that follow; eight bytes a round, for those still equal."""
    order = places[np.argsort(keys[places], kind="stable")]
    first = keys[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = first[1:] != first[:-1]
    slots = np.arange(len(order))
    for at in range(8, depth, 8):
        lone = fresh & np.append(fresh[1:], True)
        slots, fresh = slots[~lone], fresh[~lone]
        if not len(slots):
            break
        here = order[slots]
        group = np.cumsum(fresh)
        key = keys[here + at]
        by = np.lexsort((key, group))
        order[slots] = here[by]
        key, group = key[by], group[by]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    return order


def suffix_order(text: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of their first ``depth`` bytes; ``keys`` as of eight_bytes(text, depth)."""
    n = len(text)
    up = rising(text)
    direct = _sorted_directly(np.flatnonzero(up), keys, depth)
    order = np.zeros(n, np.int64)
    sizes = np.bincount(text, minlength=256)
    ends = np.cumsum(sizes)
    free = ends - sizes  # falling suffixes of a first byte come before rising ones
    falling_ends = free + np.bincount(text[~up], minlength=256)
    rising_of = np.bincount(text[up], minlength=256)
    upto = np.cumsum(rising_of)
    for c in np.flatnonzero(rising_of):
        order[falling_ends[c] : ends[c]] = direct[upto[c] - rising_of[c] : upto[c]]

    def induce(met: np.ndarray) -> None:
        before = met - 1
        before = before[before >= 0]
        before = before[~up[before]]
        by = text[before]
        before = before[np.argsort(by, kind="stable")]
        count, at = np.bincount(by, minlength=256), 0
        for c in np.flatnonzero(count):
            order[free[c] : free[c] + count[c]] = before[at : at + count[c]]
            free[c] += count[c]
            at += count[c]

    induce(np.array([n]))  # the empty suffix is the least
    for c in np.flatnonzero(sizes):
        at = ends[c] - sizes[c]
        while at < free[c]:
            met = order[at : free[c]].copy()
            at = free[c]
            induce(met)
        induce(order[falling_ends[c] : ends[c]])
    return order


def common_prefixes(order: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order, at most ``depth``."""
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, depth, 8):
        apart = keys[order[alive] + at] ^ keys[order[alive - 1] + at]
        for k in range(8):
            out[alive] += apart < np.uint64(1 << (56 - 8 * k))
        alive = alive[apart == 0]
        if not len(alive):
            break
    return np.minimum(out, depth)


def later_copies(text: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Which wanted places begin ``length`` bytes that also begin at an earlier wanted place."""
    later = np.zeros(len(text), bool)
    if not len(text):
        return later
    keys = eight_bytes(text, length + 8)
    order = suffix_order(text, keys, length)
    interval = np.cumsum(common_prefixes(order, keys, length) < length)
    asked = wanted[order]
    places, interval = order[asked], interval[asked]
    if len(places):
        heads = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
        first = np.repeat(np.minimum.reduceat(places, heads), np.diff(np.append(heads, len(places))))
        later[places[places != first]] = True
    return later
