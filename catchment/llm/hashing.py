"""64-bit hashes of words and n-grams, vectorised over the bytes of a text."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NO_WORD = np.ones(256, bool)  # outside of [0-9a-z] and non-ASCII
NO_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
BYTES = np.random.default_rng(11).integers(1 << 63, size=256, dtype=np.uint64) * U(2) + U(1)
STEP = 0x9E3779B97F4A7C15 | 5
SEGMENT = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(2 * SEGMENT, base & (2**64 - 1), U)]), dtype=U)


_POWERS: list[np.ndarray] = []


def words_at(text: bytes, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run of bytes not outside), by prefix sums of a polynomial over the bytes, and where it begins."""
    if not _POWERS:
        _POWERS.extend((powers(STEP), powers(pow(STEP, -1, 2**64))))
    up, down = _POWERS
    whole, out, places, low = np.frombuffer(text, np.uint8), [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    while low < len(whole):
        high = min(len(whole), low + SEGMENT)
        if high < len(whole):  # cut behind the last byte outside a word, or behind the word that has none
            cuts = np.flatnonzero(outside[whole[low:high]])
            while not len(cuts) and high < len(whole):
                cuts = high - low + np.flatnonzero(outside[whole[high : high + SEGMENT]])[:1]
                high = min(len(whole), high + SEGMENT)
            high = low + int(cuts[-1]) + 1 if len(cuts) else high
        raw = whole[low:high]
        inside = np.concatenate([[False], ~outside[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        if len(raw) > 2 * SEGMENT:  # one very long word
            out.append(np.array([int.from_bytes(hashlib.blake2b(raw[a:b].tobytes(), digest_size=8).digest(), "little") for a, b in zip(start, end)], U))
        else:
            sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTES[raw] * up[: len(raw)], dtype=U)])
            out.append(mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U)))
        places.append(start + low)
        low = high
    return np.concatenate(out), np.concatenate(places)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, from the hashes of the words."""
    total = np.zeros(max(0, len(words) - size + 1), U)
    for k in range(size):
        total = total * U(0xD6E8FEB86659FD93) + words[k : k + len(total)]
    return mix(total)
