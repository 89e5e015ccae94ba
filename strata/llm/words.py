"""Words and word shingles of Arrow text columns, as numpy arrays of 64-bit hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower
cased: on UTF-8 text that is the pattern [^\\x20\\x09-\\x0D]+. Texts are worked on
in runs of a few MB, so memory is bounded by that or by the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
RUN_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LETTER = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B]
_LETTER[_SPACE] = 0
_PLACE = np.random.default_rng(21).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column in one array, and the offsets of the texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def runs(off: np.ndarray, limit: int = RUN_BYTES):
    """(first, last) ranges of texts of about ``limit`` bytes; a longer text is alone."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = last


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of marked bytes; no run crosses texts."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, "right") - 1


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words."""
    return spans(~_SPACE[data], off)


def powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, length)
    value = _LETTER[data[starts[0]:]] * powers(int(length.max()))[place]
    return mix(np.add.reduceat(value, starts - starts[0]) + (ends - starts).astype(np.uint64) * _BASE)


def shingle_sets(column, limit: int = RUN_BYTES):
    """One sorted array of distinct 64-bit shingle hashes for each text, in order.

    A text of fewer words than a shingle has its whole sequence as the only one;
    a text without words has none.
    """
    data, off = flat(column)
    for first, last in runs(off, limit):
        part, o = data[off[first]:off[last]], off[first:last + 1] - off[first]
        starts, ends, doc = word_spans(part, o)
        w = np.concatenate([word_hashes(part, starts, ends), np.zeros(SHINGLE - 1, np.uint64)])
        d = np.concatenate([doc, np.full(SHINGLE - 1, -1)])
        n = len(doc)
        h = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            h += np.where(d[k:n + k] == doc, w[k:n + k] * _PLACE[k], np.uint64(0))
        h = mix(h)
        words = np.bincount(doc, minlength=last - first)
        ends_at = np.cumsum(words)
        for i in range(last - first):
            m, at = int(words[i]), int(ends_at[i] - words[i])
            yield np.unique(h[at:at + max(m - SHINGLE + 1, min(m, 1))])
