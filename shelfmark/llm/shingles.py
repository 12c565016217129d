"""Sets of hashed word shingles, computed for many texts at once with numpy."""

from __future__ import annotations

import functools

import numpy as np

WORDS = 5
#: Odd multipliers and start values of the hashes (any would do).
RADIX, SEED = 0x9E3779B97F4A7C15 | 1, 0x1B873593CC9E2D51
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes hashed at a time.
STEP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(SEED))


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64."""
    inverse = pow(RADIX, -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, r, np.uint64)])) for r in (RADIX, inverse))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` start, and their hashes."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    size = 1 << max(20, int(len(data)).bit_length())
    power, inverse = _powers(size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_byte_values()[data] * power[: len(data)], dtype=np.uint64)])
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _hashed(texts: list[bytes], n: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts).translate(LOWER), np.uint8)
    starts, words = _word_hashes(data)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    places = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(RADIX)) | np.uint64(1)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams += words[k : k + len(grams)] * places[k]
    grams = mix(grams)
    sets = []
    for first, last in zip(bounds, bounds[1:]):
        if last - first >= n:
            sets.append(np.unique(grams[first : last - n + 1]))
        elif last > first:
            few = (words[first:last] * places[: last - first]).sum(dtype=np.uint64) + np.uint64(n - (last - first))
            sets.append(mix(np.array([few], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes.

    Words are runs of other bytes than ASCII white space, A-Z in lower case. A text of fewer than ``n`` words has one
    shingle, the whole of them; without words it has none. Hashing treats a text alike wherever it stands.
    """
    coded = [(t or "").encode() for t in texts]
    sets, held, total = [], [], 0
    for text in coded:
        held.append(text)
        total += len(text)
        if total >= STEP_BYTES:
            sets += _hashed(held, n)
            held, total = [], 0
    return sets + (_hashed(held, n) if held else [])
