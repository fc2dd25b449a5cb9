"""Words of many texts at once, as array operations over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z, and whatever isn't ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at once; a word longer than this is hashed whole all the same.
BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    np.multiply.accumulate(np.full(n - 1, _STEP, np.uint64), out=out[1:])
    return out


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of every word of these bytes, in order.

    The hash is a polynomial in the word's bytes, finished by `mix`; equal
    words have equal hashes wherever they stand.
    """
    hashes, begins, ends = [], [], []
    at = 0
    while at < raw.size:
        end = min(raw.size, at + BLOCK)
        while end < raw.size and WORD_BYTE[LOWER[raw[end]]] and WORD_BYTE[LOWER[raw[end - 1]]]:
            end += 1
        low = LOWER[raw[at:end]]
        inside = WORD_BYTE[low]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        if first.size:
            place = np.arange(low.size) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [low.size]])))
            place[: first[0]] = 0
            place[~inside] = 0
            terms = _TABLE[low] * _powers(int(place.max()) + 1)[place]
            terms[~inside] = 0
            hashes.append(mix(np.add.reduceat(terms, first) + (last - first).astype(np.uint64)))
            begins.append(first + at)
            ends.append(last + at)
        at = end
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(ends)


def by_text(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like `words` for several texts laid end to end, with the number of each word's text.

    A word never spans two texts.
    """
    joined, shift = raw, None
    inner = offsets[1:-1]
    if inner.size:  # a separator between texts
        joined = np.insert(raw, inner, 32)
        shift = inner + np.arange(inner.size)
    h, b, e = words(joined)
    if shift is None:
        return h, b, e, np.zeros(h.size, np.int64)
    text = np.searchsorted(shift, b, "right")
    return h, b - text, e - text, text
