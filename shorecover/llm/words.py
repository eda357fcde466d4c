"""Words and hashes of many texts at once, as numpy arrays inside tasks.

A word is a run of bytes other than space and 0x09 to 0x0D. All functions take the texts of
one Arrow column; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes; one longer text makes a run of its own.
RUN_BYTES = 1 << 20

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """data: bytes of the run; starts, ends: of each word in data; first: index of the first word of each text, and the number of words at the end."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """The index of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first row, texts) for runs of at most about RUN_BYTES."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        chunk = chunk.cast(pa.large_string()).fill_null("")
        if not len(chunk):
            continue
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        at = 0
        while at < len(chunk):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, "right")) - 1)
            to = min(to, len(chunk))
            yield row + at, chunk.slice(at, to - at)
            at = to
        row += len(chunk)


def split(texts: pa.Array, lower: bool = False) -> Words:
    """The words of one run of texts; lower: with A-Z in lower case."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    space = SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[1:], after[:-1] = space[:-1], space[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


@lru_cache(4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power(base: int, n: int) -> np.ndarray:
    return _powers(base, max(16, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of values[start:end] for each pair."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(base, n + 1)[:n], out=sums[1:])
    return (sums[ends] - sums[starts]) * _power(pow(base, -1, 1 << 64), n + 1)[starts]


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word; it depends on the word's bytes alone."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    return mix(_rolling(_BYTES[w.data], w.starts, w.ends, int(_BASE)) + (w.ends - w.starts).astype(np.uint64))


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, 64-bit Rabin-Karp hash) of each run of `size` words of one text."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(total)
    return at, mix(_rolling(h, at, at + size, int(_STEP)))


def kept_texts(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): for each text its kept words, joined by one space."""
    n = len(w.starts)
    edge = np.zeros(len(w.data) + 1, np.int32)
    np.add.at(edge, w.starts[keep], 1)
    np.add.at(edge, w.ends[keep], -1)
    mask = np.cumsum(edge[:-1]) > 0
    data = w.data.copy()
    order = np.flatnonzero(keep)
    doc = np.searchsorted(w.first, order, "right") - 1
    last = np.ones(len(order), bool)
    last[:-1] = doc[:-1] != doc[1:]
    gaps = w.ends[order[~last]] if n else np.zeros(0, np.int64)
    mask[gaps] = True
    data[gaps] = 32
    sums = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return data[mask], sums[w.offsets]
