"""Hashes of words, shingles and word n-grams, over whole batches of texts at a time.

A word's hash is a polynomial over its bytes, read off prefix sums, then mixed; all
arithmetic is modulo 2**64. Equal words have equal hashes in any text and at any place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE_WORDS = 5
_STEP = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: 0 for white space, 1 for letters, digits and bytes of other scripts, 2 for the marks of ASCII.
_KINDS = np.full(256, 2, np.uint8)
_KINDS[_SPACES] = 0
_KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(_BASE, -1, 2**64)
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts], 7)


def _pieces(texts: Sequence[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Groups of texts of about ``_STEP`` bytes; longer ones are cut between words."""
    group: list[bytes] = []
    rows: list[int] = []
    total = 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > _STEP:
                space = _SPACE.search(text, at + _STEP)
                end = space.end() if space else end
            if group and total + end - at > _STEP:
                yield group, rows
                group, rows, total = [], [], 0
            group.append(text[at:end])
            rows.append(row)
            total += end - at
            at = end
    if group:
        yield group, rows


def word_hashes(
    texts: Sequence[bytes], *, lower: bool = True, marks: bool = False, first: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and offsets: row ``i`` has ``[at[i], at[i + 1])``.

    Words are runs without white space (space, tab to carriage return); with ``marks``,
    a run of ASCII marks is a word of its own. ``lower`` folds A-Z. ``first`` hashes no more
    than that many bytes of each word.
    """
    found, counts = [], np.zeros(len(texts) + 1, np.int64)
    for group, rows in _pieces(texts):
        data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        kinds = _KINDS[data] if marks else (~_SPACES[data]).view(np.uint8)
        change = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        edges = np.concatenate(([0], change))
        edges = edges[kinds[edges] > 0]
        following = np.concatenate((change, [len(data)]))
        ends = following[np.searchsorted(following, edges, "right")] if len(edges) else edges
        if first:
            ends = np.minimum(ends, edges + first)
        found.append(_hashes(_LOWER[data] if lower else data, edges, ends))
        bounds = np.cumsum([len(x) + 1 for x in group])
        inside = np.diff(np.searchsorted(edges, np.concatenate(([0], bounds))))
        np.add.at(counts, np.asarray(rows) + 1, inside)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.cumsum(counts)


def _chain(words: np.ndarray, length: int) -> np.ndarray:
    out = mix(words[: len(words) - length + 1], length)
    for k in range(1, length):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + words[k : len(words) - length + 1 + k], length)
    return out


def row_shingles(words: np.ndarray, at: np.ndarray, length: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each row the hashes of its shingles in order, repeats included.

    With fewer words than ``length`` the whole sequence is one shingle; without words there is none.
    """
    full = _chain(words, length) if len(words) >= length else words[:0]
    for start, end in zip(at[:-1], at[1:], strict=True):
        if end - start >= length:
            yield full[start : end - length + 1]
        elif end > start:
            yield _chain(words[start:end], int(end - start))
        else:
            yield full[:0]
