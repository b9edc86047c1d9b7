"""Polynomial hashes of words and windows over whole Arrow batches, and content-defined anchors.

Everything works on the concatenated UTF-8 bytes of a slice of texts, so the cost per byte is that of a
few vector operations; nothing crosses a text's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # texts are taken together up to this many bytes; a longer text is a slice of its own

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Powers:
    """Powers of the base modulo 2**64 and their inverses, extended when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            setattr(self, name, np.multiply.accumulate(row))


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PrefixHash:
    """Hash of any range of a sequence of 64-bit values from prefix sums."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        _POWERS.reach(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _POWERS.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _POWERS.down[start]


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null texts are empty."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    row = 0
    while row < len(column):
        total, end = 0, row
        while end < len(column) and (end == row or total + lengths[end] <= limit):
            total += lengths[end]
            end += 1
        part = pa.compute.fill_null(column.slice(row, end - row), "")
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = part.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        yield row, end, raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the word index at every text's start."""
    word = np.ones(len(data) + 1, dtype=bool)
    word[:-1] = ~_SPACE[data]
    word[-1] = False
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge))
    ends = np.flatnonzero(before & (~word | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(PrefixHash(byte_values(data)).of(starts, ends) + (ends - starts).astype(np.uint64))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over ``values[i : i + width]`` for every i with a whole window, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(values: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> dict[str, np.ndarray]:
    """Content-defined anchors: every window of ``window`` values holds a chosen gram, its smallest hash.

    Equal windows choose equal grams wherever they stand. For each chosen gram: ``text`` (index of its
    text), ``at`` (its place), ``key`` (its hash), ``start`` and ``end`` (all windows that hold it, cut at
    the text's ends) and ``content`` (hash of that range and of the gram's place in it). Places count
    from the text's first value. Texts shorter than a window have none.
    """
    n, width = len(values), window - gram + 1
    names = ("text", "at", "key", "start", "end", "content")
    if n < window:
        return {x: np.zeros(0, np.int64) for x in names}
    prefix = PrefixHash(values)
    i = np.arange(n - gram + 1)
    text = np.searchsorted(bounds, i, side="right") - 1
    last = bounds[text + 1]
    grams = mix(prefix.of(i, i + gram)) | np.uint64(1)
    grams[i + gram > last] = _MAX
    low = _sliding(grams, width, np.minimum)
    low[i[: len(low)] + window > last[: len(low)]] = 0
    padded = np.zeros(len(low) + 2 * (width - 1), dtype=np.uint64)
    padded[width - 1 : width - 1 + len(low)] = low
    high = _sliding(padded, width, np.maximum)
    at = np.flatnonzero(high == grams[: len(high)])
    text = text[at]
    first, last = bounds[text], bounds[text + 1]
    start, end = np.maximum(first, at - (width - 1)), np.minimum(last, at + window)
    content = mix(prefix.of(start, end) + ((at - start).astype(np.uint64) << np.uint64(32)) + (end - start).astype(np.uint64))
    return {
        "text": text, "at": at - first, "key": grams[at].view(np.int64),
        "start": start - first, "end": end - first, "content": content.view(np.int64),
    }
