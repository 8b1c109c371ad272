"""Hashes of a text's words and shingles in numpy; a word is what lies between ASCII white space."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at once; longer texts are cut at white space.
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 5
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def _hash_slice(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[: len(data)])))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """One 64-bit hash for each word, A-Z lower-cased if asked."""
    data = np.frombuffer(text, np.uint8)
    if lower:
        data = _LOWER[data]
    parts, at = [], 0
    while len(data) - at > SLICE:
        space = np.flatnonzero(_SPACE[data[at : at + SLICE]])
        if not len(space):  # one word longer than a slice: it ends at the next white space
            space = np.flatnonzero(_SPACE[data[at:]])
            if not len(space):
                break
        parts.append(_hash_slice(data[at : at + space[-1] if space[-1] else at + 1]))
        at += max(int(space[-1]), 1)
    parts.append(_hash_slice(data[at:]))
    return np.concatenate(parts)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of the whole sequence if shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(0x2545F4914F6CDD1D) + words[k : len(words) - size + 1 + k])
    return np.unique(total)
