"""Substring dedup by suffix automata of reference shards and matching statistics of the documents.

The reference of every word is all text before it. Broadcasting automata of the whole corpus to every
document would be quadratic, so shards are made by content (``repeats``): all places where one gram
stands are in one shard, whose automaton meets just the document stretches that can match it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bidscope.llm import hashing
from bidscope.llm.repeats import Shard, Windows, identified, removed_mask, repeated_spans, with_spans

WORDS = Windows(unit="words", size=20, gram=8, keep_first=True, shard_units=60_000)


class SuffixAutomaton:
    """Automaton of all substrings of several word sequences, with the end of each one's first occurrence.

    Sequences are added in document order, so a state's first end is the earliest of all its places.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [-1]
        self.last = 0

    def _state(self, edges: dict[int, int], link: int, length: int, first_end: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first_end.append(first_end)
        return len(self.next) - 1

    def begin(self) -> None:
        """A new sequence starts: no substring reaches across."""
        self.last = 0

    def add(self, word: int, end: int) -> None:
        edges, link, length = self.next, self.link, self.length
        p = self.last
        known = edges[p].get(word)
        if known is not None:
            if length[known] == length[p] + 1:
                self.last = known
                return
            self.last = self._split(p, known, word)
            return
        new = self._state({}, 0, length[p] + 1, end)
        while p >= 0 and word not in edges[p]:
            edges[p][word] = new
            p = link[p]
        if p >= 0:
            q = edges[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
        self.last = new

    def _split(self, p: int, q: int, word: int) -> int:
        """Gives the substrings of ``q`` that end the shorter path over ``p`` a state of their own."""
        edges, link = self.next, self.link
        clone = self._state(dict(edges[q]), link[q], self.length[p] + 1, self.first_end[q])
        while p >= 0 and edges[p].get(word) == q:
            edges[p][word] = clone
            p = link[p]
        link[q] = clone
        return clone

    def earlier(self, words: list[int], at: int, size: int) -> list[int]:
        """Ends of the windows of ``size`` words that also end earlier; ``at`` is the first word's place.

        The matching statistic of each place is followed up to ``size`` words: the state of the longest
        match that ends there, cut back along suffix links to the window's own state.
        """
        edges, link, length, first_end = self.next, self.link, self.length, self.first_end
        state = matched = 0
        found = []
        for i, word in enumerate(words, at):
            while state and word not in edges[state]:
                state = link[state]
                matched = length[state]
            target = edges[state].get(word)
            if target is None:
                continue
            state, matched = target, matched + 1
            if matched >= size:
                while length[link[state]] >= size:
                    state = link[state]
                matched = size
                if first_end[state] < i:
                    found.append(i)
        return found


def _candidates(shard: Shard, size: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """Stretch, first word, words of the parts whose windows have an equal hash elsewhere in the shard."""
    data = np.frombuffer(b"".join(shard.bodies), np.uint8)
    offsets = np.cumsum([0, *map(len, shard.bodies)])
    starts, ends, bounds = hashing.words(data, offsets)
    prefix = hashing.PrefixHash(hashing.word_hashes(data, starts, ends))
    at = np.arange(max(0, len(starts) - size + 1))
    owner = np.searchsorted(bounds, at, side="right") - 1
    at = at[at + size <= bounds[owner + 1]] if len(at) else at
    _, which, counts = np.unique(prefix.of(at, at + size), return_inverse=True, return_counts=True)
    at = at[counts[which] > 1]
    owner = np.searchsorted(bounds, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > size) | (np.diff(owner) != 0)
    edges = np.append(np.flatnonzero(new), len(at))
    for a, b in zip(edges[:-1], edges[1:]):
        k, low, high = owner[a], at[a], at[b - 1] + size
        yield k, low - bounds[k], high - bounds[k], shard.bodies[k].split()[low - bounds[k] : high - bounds[k]]


def earlier_windows(shard: Shard, size: int = WORDS.size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, start and stop of the words of windows that stand earlier in the shard."""
    numbers: dict[bytes, int] = {}
    parts = [(k, low, [numbers.setdefault(x, len(numbers)) for x in words]) for k, low, _, words in _candidates(shard, size)]
    automaton = SuffixAutomaton()
    place = 0
    for _, _, words in parts:
        automaton.begin()
        for i, word in enumerate(words, place):
            automaton.add(word, i)
        place += len(words)
    out: list[tuple[int, int, int]] = []
    place = 0
    for k, low, words in parts:
        for end in automaton.earlier(words, place, size):
            stop = low + end - place + 1
            if out and out[-1][0] == k and out[-1][2] >= stop - size:
                out[-1] = (k, out[-1][1], stop)
            else:
                out.append((k, stop - size, stop))
        place += len(words)
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def remove_repeats(docs: DataFrame, windows: Windows = WORDS) -> DataFrame:
    """All columns of the documents, with ``spans`` of the words to remove (null: none).

    A word goes if a window over it stands earlier: in a smaller document, or before in the same. Ids
    that repeat or are missing: see ``repeats.identified``. A null or empty text has no words; a table
    without documents gives an empty result.
    """
    rows, texts = identified(docs)
    method = lambda shard: earlier_windows(shard, windows.size)
    return with_spans(rows, repeated_spans(texts, windows, method)).drop("_doc", "_copy")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, sha = [], [], []
            for text, spans in zip(batch["_text"], batch["spans"]):
                words = text.as_py().encode().split()
                mask = removed_mask(len(words), spans.as_py())
                kept = [x for x, m in zip(words, mask) if not m] if mask.any() else words
                total.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = remove_repeats(docs.select("doc_id", "text")).select("doc_id", "_text", "spans")
    return found.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
