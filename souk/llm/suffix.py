"""Repeated strings of a minimum length in a text, from its Burrows-Wheeler transform.

Suffixes are sorted by their first 64 bytes, which fixes the blocks of all strings up to that length. From the transform
of that order, the blocks (intervals) of strings of length 1, 2, 3, ... are found breadth first: an interval is extended
to the left by each byte that precedes its suffixes. The first interval to end before a suffix fixes that suffix's common
prefix with the one before it, so common prefixes come out by increasing value, and only intervals that fixed one are
extended further. At the minimum length the work stops: what is still open shares at least so many bytes.
"""

from __future__ import annotations

import numpy as np

#: Parts texts from each other: a byte that UTF-8 never has.
SENTINEL = 0xFF
#: Suffixes are sorted by so many bytes, in rounds that double.
DEPTH = 64


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes by their first DEPTH bytes, sentinels beyond the end; ties in any order."""
    n = text.size
    padded = np.concatenate([text, np.full(DEPTH, SENTINEL, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    order = np.argsort(key)
    depth = 8
    while True:
        own = key[order]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        rank = np.empty(n + DEPTH, np.uint64)
        rank[n:] = n
        rank[order] = np.cumsum(new)
        if depth >= DEPTH or new.all():
            return order
        key = rank[:n] * np.uint64(n + 1) + rank[depth : depth + n]
        order = np.argsort(key)
        depth *= 2


def shared_prefix_groups(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, group): the positions of text where a string of `least` bytes without a sentinel starts that starts elsewhere
    too; equal strings, and only those, have one group number. least is at most DEPTH - 1."""
    n = text.size
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_order(text)
    before = text[order - 1]  # the transform; position 0 is preceded by the last sentinel
    before[order == 0] = SENTINEL
    stable = np.argsort(before, kind="stable")
    to_front = np.empty(n, np.int64)  # where the suffix goes that is one byte longer
    to_front[stable] = np.arange(n)
    # extension by a byte keeps the order of suffixes within a first byte, so blocks of one byte start at these places
    first = text[order]
    shift = np.searchsorted(first, np.arange(256)) - np.searchsorted(before[stable], np.arange(256))
    to_front += shift[before]
    usable = before != SENTINEL
    fixed = np.zeros(n + 1, bool)
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(least):
        sizes = high - low + 1
        at = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        owner = np.repeat(np.arange(low.size), sizes)
        keep = usable[at]
        at, owner = at[keep], owner[keep]
        if not at.size:
            break
        target = to_front[at]
        by_target = np.argsort(target)
        target, owner, byte = target[by_target], owner[by_target], before[at[by_target]]
        ends = np.concatenate([np.flatnonzero((np.diff(owner) != 0) | (np.diff(byte.astype(np.int16)) != 0)), [target.size - 1]])
        begins = np.concatenate([[0], ends[:-1] + 1])
        low, high = target[begins], target[ends]
        new = ~fixed[high + 1]
        low, high = low[new], high[new]
        fixed[high + 1] = True
    # a suffix with a sentinel in its first bytes shares nothing that counts
    ends_at = np.flatnonzero(text == SENTINEL)
    next_end = np.concatenate([ends_at, [n]])[np.searchsorted(ends_at, np.arange(n))]
    short = (next_end - np.arange(n) < least)[order]
    fixed[:n] |= short
    fixed[1:] |= short
    fixed[0] = True
    group = np.cumsum(fixed[:n])
    shared = ~short & (np.bincount(group)[group] > 1)
    return order[shared], group[shared]
