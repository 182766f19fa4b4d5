"""Words and shingles of texts as 64-bit hashes, with numpy over whole blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240607)
BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWERED = BYTES[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BASE, BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
PLACES = (_RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
BLOCK = 1 << 20

_powers = {BASE: np.ones(1, np.uint64), BACK: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each non-empty span; equal contents have equal hashes anywhere."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    raw = (total[ends] - total[starts]) * powers(BACK, len(values) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * PLACES[0])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside [\\x20\\x09-\\x0D]."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as UTF-8, of about BLOCK bytes each, with the first one's position."""
    at, run, size = 0, [], 0
    for i, text in enumerate(texts):
        run.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(run[-1])
        if size >= BLOCK:
            yield at, run
            at, run, size = i + 1, [], 0
    if run:
        yield at, run


def words_of(texts: list[str | None], table: np.ndarray = LOWERED) -> Iterator[np.ndarray]:
    """For each text its words' hashes in order."""
    for _, run in blocks(texts):
        data = np.frombuffer(b" ".join(run), np.uint8)
        starts, ends = word_spans(data)
        hashes = spans_hash(table[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
        at = 0
        for raw in run:
            a, b = np.searchsorted(starts, (at, at + len(raw)))
            at += len(raw) + 1
            yield hashes[a:b]


def shingles_of(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles' hashes, ascending; texts with fewer words have one of all words, empty ones none."""
    for hashes in words_of(texts):
        n = len(hashes)
        if n >= width:
            sums = np.zeros(n - width + 1, np.uint64)
            for k in range(width):
                sums += hashes[k : n - width + 1 + k] * PLACES[k + 1]
            yield np.unique(mix(sums))
        elif n:
            yield mix(np.array([int((hashes * PLACES[1 : n + 1]).sum(dtype=np.uint64)) ^ (n * 0x632BE59BD9B4E019 % 2**64)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
