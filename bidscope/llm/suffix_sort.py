"""Suffix-array dedup: suffixes sorted by merging, compared through prefix hashes.

Two suffixes are compared by binary search for their common extension on prefix polynomial hashes, so a
comparison takes a logarithmic number of steps however long the common part. Extensions that count are
verified byte by byte. What is sorted at a time is a shard of ``repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bidscope.llm import hashing
from bidscope.llm.repeats import Shard, Windows, identified, removed_mask, repeated_spans, with_spans
from bidscope.llm.rows import packed, unpacked

BYTES = Windows(unit="bytes", size=400, gram=256, keep_first=False, shard_units=1 << 20)
# For corpora: passages of 51 words begin at about 285 bytes, so all of them hold such a window.
PASSAGES = Windows(unit="bytes", size=250, gram=128, keep_first=False, shard_units=1 << 20)


class Suffixes:
    """The suffixes of several byte strings in one buffer; none reaches over its string's end."""

    def __init__(self, bodies: list[bytes]) -> None:
        self.raw = b"".join(bodies)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.bounds = np.cumsum([0, *map(len, bodies)])
        self.prefix = hashing.PrefixHash(hashing.byte_values(self.data))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.head = np.zeros(len(self.data), np.uint64)  # the first eight bytes as a number
        for k in range(8):
            self.head |= padded[k : k + len(self.data)] << np.uint64(56 - 8 * k)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def end(self, at: np.ndarray) -> np.ndarray:
        return self.bounds[self.owner(at) + 1]

    def extension(self, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Common bytes of suffixes pair by pair, by binary search on the hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(a_end - a, b_end - b)
        while (open_ := low < high).any():
            i = np.flatnonzero(open_)
            middle = (low[i] + high[i] + 1) // 2
            same = self.prefix.of(a[i], a[i] + middle) == self.prefix.of(b[i], b[i] + middle)
            low[i] = np.where(same, middle, low[i])
            high[i] = np.where(same, high[i], middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b; a suffix that is a part of another comes first, equals by place."""
        out = self.head[a] < self.head[b]
        i = np.flatnonzero((self.head[a] == self.head[b]) | (a_end - a < 8) | (b_end - b < 8))
        x, y, x_end, y_end = a[i], b[i], a_end[i], b_end[i]
        n = self.extension(x, y, x_end, y_end)
        x_over, y_over = x + n >= x_end, y + n >= y_end
        last = len(self.data) - 1
        less = self.data[np.minimum(x + n, last)] < self.data[np.minimum(y + n, last)]
        out[i] = np.where(x_over & y_over, x < y, np.where(x_over, True, np.where(y_over, False, less)))
        return out

    def sort(self, at: np.ndarray) -> np.ndarray:
        """The suffixes at these places in order: bottom-up mergesort, all merges of a level at once.

        In a merge each suffix finds its place in the other run by binary search. Runs start out in order
        of their first bytes, so most comparisons of the first levels end there.
        """
        at = at[np.argsort(self.head[at], kind="stable")]
        ends, width, n = self.end(at), 1, len(at)
        while width < n:
            i = np.arange(n)
            start = i // (2 * width) * (2 * width)
            in_left = i < start + width
            low = np.where(in_left, np.minimum(start + width, n), start)
            first = low.copy()
            high = np.where(in_left, np.minimum(start + 2 * width, n), np.minimum(start + width, n))
            # Runs that already follow each other need no search.
            edge = start + width
            edge_in = edge < n
            ordered = np.ones(n, bool)
            e = np.unique(edge[edge_in])
            ordered_runs = self.before(at[e - 1], at[e], ends[e - 1], ends[e])
            ordered[edge_in] = ordered_runs[np.searchsorted(e, edge[edge_in])]
            open_ = np.flatnonzero(~ordered & (low < high))
            while len(open_):
                middle = (low[open_] + high[open_]) // 2
                goes = self.before(at[middle], at[open_], ends[middle], ends[open_])
                low[open_] = np.where(goes, middle + 1, low[open_])
                high[open_] = np.where(goes, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            rank = low - first
            own = np.where(in_left, i - start, i - (start + width))
            place = np.where(ordered, i, start + own + rank)
            merged, merged_ends = np.empty_like(at), np.empty_like(ends)
            merged[place], merged_ends[place] = at, ends
            at, ends, width = merged, merged_ends, 2 * width
        return at

    def verified(self, a: int, b: int, n: int) -> int:
        """The hashed extension if the bytes agree; else what they truly share."""
        if self.raw[a : a + n] == self.raw[b : b + n]:
            return n
        differ = self.data[a : a + n] != self.data[b : b + n]
        return int(np.argmax(differ))


def _heads(s: Suffixes, size: int) -> np.ndarray:
    """Places whose suffixes must be sorted: where a run of windows with an equal window elsewhere begins,
    and one such equal window each.

    Windows are looked up by hash. Within a run the partner moves along with the window, so the run lies
    in the common extension of its first window and that one's partner.
    """
    at = np.arange(max(0, len(s.data) - size + 1))
    at = at[at + size <= s.end(at)] if len(at) else at
    if not len(at):
        return at
    _, first, which, counts = np.unique(s.prefix.of(at, at + size), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    second = order[np.minimum(np.cumsum(counts) - counts + 1, len(order) - 1)]
    partner = np.where(first[which] == np.arange(len(at)), second[which], first[which])
    shared = counts[which] > 1
    at, partner = at[shared], at[partner][shared]
    begins = np.ones(len(at), bool)
    begins[1:] = (np.diff(at) != 1) | (np.diff(partner) != 1)
    return np.unique(np.concatenate([at[begins], partner[begins]]))


def shared_windows(shard: Shard, size: int = BYTES.size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, start and stop of the bytes of windows that also start elsewhere in the shard."""
    s = Suffixes(shard.bodies)
    order = s.sort(_heads(s, size))
    if len(order) < 2:
        none = np.zeros(0, np.int64)
        return none, none, none
    a, b = order[:-1], order[1:]
    n = s.extension(a, b, s.end(a), s.end(b))
    best = np.zeros(len(order), np.int64)
    for i in np.flatnonzero(n >= size):
        true = s.verified(int(a[i]), int(b[i]), int(n[i]))
        best[i], best[i + 1] = max(best[i], true), true
    long = best >= size
    at, stop = order[long], order[long] + best[long]
    which = s.owner(at)
    return which, at - s.bounds[which], stop - s.bounds[which]


def find_repeats(docs: DataFrame, windows: Windows = BYTES) -> DataFrame:
    """All columns of the documents, with ``spans`` of the UTF-8 bytes to remove (null: none).

    A byte goes if a window over it also starts anywhere else; all copies go. Ids that repeat or are
    missing: see ``repeats.identified``. A null or empty text has no bytes; a table without documents
    gives an empty result.
    """
    rows, texts = identified(docs)
    method = lambda shard: shared_windows(shard, windows.size)
    return with_spans(rows, repeated_spans(texts, windows, method)).drop("_doc", "_copy")


def kept_bytes(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """The bytes outside all ranges, and the number of maximal removed runs."""
    if not spans:
        return raw, 0
    mask = removed_mask(len(raw), spans)
    runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
    return np.frombuffer(raw, np.uint8)[~mask].tobytes(), runs


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["_text"], batch["spans"]):
                raw = text.as_py().encode()
                kept, runs = kept_bytes(raw, spans.as_py())
                rows.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *numbers, pa.array([r[3] for r in rows], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = find_repeats(docs.select("doc_id", "text")).select("doc_id", "_text", "spans")
    return found.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def kept_text(text: str, spans: list[dict]) -> str:
    """The text without the ranges of its bytes; a character of which any byte goes is left out whole."""
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    gone = np.bincount(character, removed_mask(len(data), spans)) > 0
    return data[~gone[character]].tobytes().decode()


def without_repeats(docs: DataFrame, windows: Windows = BYTES) -> DataFrame:
    """The documents, all columns kept, with the repeated bytes cut out of ``text``; a null text stays null."""
    keep = ["doc_id", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch["text"], batch["spans"]):
                value, ranges = text.as_py(), spans.as_py()
                texts.append(kept_text(value, ranges) if value and ranges else value)
            columns = [batch["doc_id"], pa.array(texts, pa.string()), batch["_rest"]]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "_rest"])

    slim = packed(docs, keep)
    found = find_repeats(slim, windows).select(*keep, "_rest", "spans")
    return unpacked(found.mapInArrow(run, slim.schema), docs.columns, keep)
