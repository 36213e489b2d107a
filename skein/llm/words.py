"""Words of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def alphanumeric() -> np.ndarray:
    """Bytes of words made of digits, letters and anything beyond ASCII."""
    m = np.zeros(256, bool)
    m[48:58] = m[65:91] = m[97:123] = m[128:] = True
    return m


def non_blank() -> np.ndarray:
    """Bytes of words that are parted by blanks, tabs and line breaks (0x09-0x0D) only."""
    m = np.ones(256, bool)
    m[9:14] = m[32] = False
    return m


def lower_bytes() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


_LOWER = lower_bytes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(31)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word (A-Z in lower case), n + 1 offsets of each text's words, and each word's first and end byte."""
    inside = is_word[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(raw)]
    start[edge] = inside[edge]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), at, at
    first = np.flatnonzero(start[at])
    size = np.diff(np.append(first, len(at)))
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(size.max()), _STEP, np.uint64))
        place = np.arange(len(at)) - np.repeat(first, size)
        h = np.add.reduceat(_BYTE[_LOWER[raw[at]]] * powers[place], first)
    begin = at[first]
    return mixed(h + size.astype(np.uint64)), np.searchsorted(begin, offsets), begin, begin + size


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for every n consecutive word hashes."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            out = out * _STEP + h[k:k + len(out)]
        return mixed(out)


def shingles(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts (with repeats) and n + 1 offsets; a text of fewer than n words, but
    not none, has its whole sequence as one shingle."""
    words = np.diff(bounds)
    count = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(count)])
    all_of = rolled(h, n)
    owner = np.repeat(np.arange(len(words)), count)
    at = bounds[:-1][owner] + np.arange(ends[-1]) - ends[:-1][owner]
    out = np.zeros(ends[-1], np.uint64)
    full = words[owner] >= n
    out[full] = all_of[at[full]]
    for i in np.flatnonzero((words > 0) & (words < n)).tolist():
        own = h[bounds[i]:bounds[i + 1]]
        out[ends[i]] = mixed(rolled(own, len(own)) + np.uint64(len(own)))[0]
    return out, ends
