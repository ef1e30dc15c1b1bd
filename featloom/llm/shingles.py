"""Word shingles of many texts at once, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from featloom.llm.common import mix64

BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of texts that are hashed together.
GROUP = 250_000
#: Most powers that a task keeps for the next group.
KEPT = 1 << 21


BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
#: A random value for each byte.
VALUE = mix64(np.arange(1, 257, dtype=np.uint64))


#: The powers that a task has kept so far.
_kept: list[np.ndarray] = []


def _new_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.full(size, BASE, np.uint64), dtype=np.uint64)
    return up, np.cumprod(np.full(size, pow(BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least `size` powers of BASE and of its inverse."""
    if size > KEPT:
        return _new_powers(size)
    if not _kept or len(_kept[0]) < size:
        _kept[:] = _new_powers(1 << max(0, size - 1).bit_length())
    return _kept[0], _kept[1]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (bytes between blanks), and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    up, down = powers(len(data))
    gap = BLANK[data]
    before = np.concatenate(([True], gap[:-1]))
    start = np.nonzero(~gap & before)[0]
    end = np.nonzero(gap & ~before)[0]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUE[data] * up[:len(data)], dtype=np.uint64)))
    hashes = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, sorted within it, and where each text's end.

    A-Z count as lower case. A text of fewer words is one shingle, a text without words has none.
    """
    sets, sizes, group, total = [], [], [], 0
    for i, text in enumerate(texts):
        group.append((text or "").encode().lower())
        total += len(group[-1])
        if total >= GROUP or i + 1 == len(texts):
            _sets_of(group, width, sets, sizes)
            group, total = [], 0
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(np.array(sizes, np.int64))


def _sets_of(texts: list[bytes], width: int, sets: list, sizes: list) -> None:
    hashes, counts = words(texts)
    odd = mix64(np.arange(1001, 1001 + width, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        rolled += hashes[j:n - width + 1 + j] * odd[j]
    rolled = mix64(rolled)
    first = 0
    for count in counts.tolist():
        if count >= width:
            own = np.sort(rolled[first:first + count - width + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif count:
            part = (hashes[first:first + count] * odd[:count]).sum(dtype=np.uint64)
            own = mix64(np.array([part], np.uint64) ^ np.uint64(count))
        else:
            own = rolled[:0]
        sets.append(own)
        sizes.append(len(own))
        first += count
