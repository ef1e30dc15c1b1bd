"""Suffix arrays of one shard's bytes, and merging of sorted shards, in numpy."""

from __future__ import annotations

import numpy as np


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros after the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    return np.ndarray(len(text), ">u8", padded, strides=(1,)).astype(np.uint64)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and the rank of each, by Larsson and Sadakane's refinement.

    Suffixes start in groups of equal first eight bytes. A group's suffixes are then told apart by the group
    of the suffix h bytes on, h doubles, and groups of one are never touched again. The end of the text
    comes before every byte.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = _words(text)
    order = np.argsort(first)
    sorted_ = first[order]
    starts = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    # zeros after the end look like zero bytes: the last suffixes get their order from their lengths
    group = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    h = 0
    del first, sorted_
    open_ = _unsorted(starts)
    while len(open_):
        # h = 0 orders the suffixes within the last eight bytes, which the zeros may have mixed up
        here = order[open_]
        if h == 0:
            key = np.where(n - here < 8, n - here, 8)
        else:
            after = here + h
            key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        own = rank[here]
        if h > 0 or (key < 8).any():
            by = np.argsort(own * (n + 9) + key)
            here, key, own = here[by], key[by], own[by]
            order[open_] = here
            new = np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])))
            rank[here] = np.maximum.accumulate(np.where(new, open_, 0))
            alone = new & np.concatenate((new[1:], [True]))
            open_ = open_[~alone]
        h = 8 if h == 0 else 2 * h
    return order, rank


def _unsorted(starts: np.ndarray) -> np.ndarray:
    alone = starts & np.concatenate((starts[1:], [True]))
    return np.nonzero(~alone)[0]


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sorted suffix with the one before it, by Kasai's relation.

    Where a suffix and its neighbour are preceded by the same byte, their common prefix is one shorter than
    that of the suffixes one byte before. Only the other positions are compared, eight bytes at a time.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    own = np.ones(n, bool)
    follows = (before > 0) & (at > 0)
    i = at[follows]
    # the neighbour of the position before must be the position before the neighbour
    own[i] = (text[i - 1] != text[before[i] - 1]) | (before[i - 1] != before[i] - 1)
    own[before < 0] = False
    length = np.zeros(n, np.int64)
    todo = np.nonzero(own)[0]
    words = _words(text)
    a, b, done, last = todo, before[todo], np.zeros(len(todo), np.int64), np.zeros(len(todo), np.uint64)
    alive = np.arange(len(todo))
    while len(alive):
        x, y = a[alive] + done[alive], b[alive] + done[alive]
        inside = np.maximum(x, y) < n
        differ = words[np.minimum(x, n - 1)] ^ words[np.minimum(y, n - 1)]
        same = inside & (differ == 0)
        # the words that differ; past the end no byte is equal
        last[alive[~same]] = np.where(inside, differ, np.uint64((1 << 64) - 1))[~same]
        alive = alive[same]
        done[alive] += 8
    done += _leading_bytes(last)
    length[todo] = np.minimum(done, n - np.maximum(a, b))
    base = np.maximum.accumulate(np.where(own, at, 0))
    derived = length[base] - (at - base)
    derived[before < 0] = 0
    return derived[order]


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the high end of numbers that are not zero."""
    out = np.zeros(len(x), np.int64)
    for bits in range(8, 64, 8):
        out += (x >> np.uint64(64 - bits)) == 0
    return out


def window_groups(text: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of `width` bytes at `starts`: the group of each, and a start for each group, in sorted order."""
    order, rank = suffix_array(text)
    lcp = common_prefixes(text, order, rank)
    group_of_rank = np.cumsum(lcp < width)
    raw = group_of_rank[rank[starts]]
    at = np.full(len(text) + 1, -1, np.int64)
    at[raw] = starts
    there = at >= 0
    return (np.cumsum(there) - 1)[raw], at[there]


def merge(known: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of distinct windows with a least value each, merged by binary search."""
    windows, least = known
    others, values = more
    if not len(windows):
        return others, values
    place = np.searchsorted(windows, others)
    there = np.minimum(place, len(windows) - 1)
    equal = windows[there] == others
    least = least.copy()
    least[there[equal]] = np.minimum(least[there[equal]], values[equal])
    return np.insert(windows, place[~equal], others[~equal]), np.insert(least, place[~equal], values[~equal])
