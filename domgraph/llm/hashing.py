"""Vectorized hashing of spans of bytes, shared by the operators that hash words, sentences and n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: True for bytes 9 to 13 and 32.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: True for ASCII letters and digits and for every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[128:] = True
WORD[48:58] = WORD[65:91] = WORD[97:123] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of value times base to its position, from which the hash of any span follows."""
    up = _powers(len(values) + 1)[0]
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each span; equal spans have equal hashes wherever they stand."""
    down = _powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def scale(n: int) -> np.ndarray:
    """What moves a difference of prefix sums that starts at each of n positions to position zero."""
    return _powers(n + 1)[1][:n]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def chunks(batch: Iterable[tuple], text_at: int, most_bytes: int = 512 << 10) -> Iterator[list[tuple]]:
    """Rows in lists whose texts have about so many bytes together, or one longer text alone."""
    held: list[tuple] = []
    size = 0
    for row in batch:
        n = len(row[text_at] or "")
        if held and size + n > most_bytes:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held
