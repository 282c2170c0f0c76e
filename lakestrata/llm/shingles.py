"""Sets of hashed word shingles, computed over many texts at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed together up to so many bytes (a longer text alone), which bounds the working arrays.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and lengths of all words of texts, and the number of words before each text (one entry more than texts)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    if fold:
        data = _LOWER[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    hashes = mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, (end - start).astype(np.uint64), np.searchsorted(start, begin)


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text) + 1
    if chunk:
        yield chunk


def _ordered(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """hashes with the shingle's length in the upper six bits, longest first: a fixed order of tokens in which the long
    ones, which chance repeats least, come before the short ones."""
    return (hashes >> np.uint64(6)) | ((np.uint64(63) - np.minimum(lengths, np.uint64(63))) << np.uint64(58))


def shingle_sets(texts: list[bytes], words: int, fold: bool = True) -> Iterator[np.ndarray]:
    """For each text the sorted distinct tokens of its shingles of so many words; of all its words, if they are fewer."""
    for chunk in _chunks(texts):
        with np.errstate(over="ignore"):
            hashes, lengths, first = _word_hashes(chunk, fold)
            n = max(0, len(hashes) - words + 1)
            windows, size = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for i in range(words):
                windows = windows * _STEP + hashes[i : i + n]
                size += lengths[i : i + n]
            windows = _ordered(mix(windows), size)
            for a, b in zip(first[:-1], first[1:]):
                if b - a >= words:
                    one = np.sort(windows[a : b - words + 1])
                    yield one[np.concatenate(([True], one[1:] != one[:-1]))]
                elif b > a:
                    few = np.uint64(b - a)
                    for h in hashes[a:b]:
                        few = few * _STEP + h
                    yield _ordered(mix(np.array([few], np.uint64)), lengths[a:b].sum(keepdims=True))
                else:
                    yield np.zeros(0, np.uint64)
