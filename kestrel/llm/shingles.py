"""Hashes of word shingles, for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5  # words in a shingle; a shorter text is one shingle of all its words
BLOCK = 1 << 20  # bytes worked on at once; a longer text is a block of its own
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) with about BLOCK bytes each."""
    first, part, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if part and size + len(raw) > BLOCK:
            yield first, part
            first, part, size = i, [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield first, part


def shingle_hashes(part: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of the texts in order, and where each text's begin
    (one more bound at the end)."""
    n = len(part)
    code = np.frombuffer(b"\n" + b"\n".join(part) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in part])  # of the text's closing space
    space = _SPACE[code]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
    size = stop - start
    at = np.flatnonzero(~space)
    place = at - np.repeat(start, size)
    power = np.full(int(size.max()), 0x9E3779B97F4A7C15, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    word = mix(np.add.reduceat((code[at].astype(np.uint64) + np.uint64(1)) * power[place], first) + size.astype(np.uint64))
    bound = np.searchsorted(start, np.concatenate([[0], ends]), side="left")
    count = np.diff(bound)
    made = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    index = np.arange(begin[-1]) - np.repeat(begin[:-1], made) + np.repeat(bound[:-1], made)
    left = np.repeat(bound[1:], made) - index
    word = np.concatenate([word, np.zeros(words, np.uint64)])
    total = np.zeros(len(index), np.uint64)
    factor = np.uint64(1)
    for j in range(words):
        factor = np.uint64((int(factor) * 0xD6E8FEB86659FD93 + 2 * j) & ((1 << 64) - 1) | 1)
        total += np.where(left > j, word[index + j], np.uint64(0)) * factor
    return mix(total), begin
