"""Byte-pair encoding and decoding with a contiguous rank array per word."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The split of byte-level vocabularies and the byte ranges that stand for themselves.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = [(33, 126), (161, 172), (174, 255)]

SHORT_WORD = 256  # bytes; longer words are merged through a heap
CACHED_WORDS = 1 << 19  # words whose ids a worker keeps; the store is emptied when full
LONG_TEXT = 1 << 20  # characters from which a text is encoded in stretches
CHUNK_WORDS = 1 << 16  # words of such a stretch

_ID_BITS = 24
_ID_MASK = (1 << _ID_BITS) - 1
_NONE = 1 << 62


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte."""
    plain = [b for low, high in PLAIN_BYTES for b in range(low, high + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Store(dict):
    """Values by key, made when first asked for."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        byte_of = {letter: b for b, letter in letters.items()}
        vocab = spec["model"]["vocab"]
        self.of_byte = [vocab[letters[b]] for b in range(256)]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.merges: dict[int, int] = {}  # left and right id in one number: rank and merged id in one number
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << _ID_BITS | vocab[right]] = rank << _ID_BITS | vocab[left + right]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.digits_of = {i: b"%d" % i for i in self.bytes_of}
        self.split = regex.compile(SPLIT)
        special = sorted(self.special, key=len, reverse=True)
        self.by_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = _Store(lambda word: tuple(self.merge(word.encode())))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word.

        ``parts`` holds the token between each two boundaries and ``ranks`` the rank of joining it with
        the next one, side by side. The array is scanned for the smallest rank (the leftmost of equals),
        that boundary is deleted, and the ranks on both sides are looked up anew.
        """
        if len(word) > SHORT_WORD:
            return self._merge_long(word)
        get = self.merges.get
        of_byte = self.of_byte
        parts = [of_byte[b] for b in word]
        ranks = [get(a << _ID_BITS | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            parts[i] = joined = low & _ID_MASK
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(joined << _ID_BITS | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << _ID_BITS | joined, _NONE)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        """The same merges in the same order, with a heap of ranks over linked parts."""
        get, n = self.merges.get, len(word)
        parts = [self.of_byte[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (m := get(parts[i] << _ID_BITS | parts[after[i]])) is not None:
                heapq.heappush(heap, (m, i, parts[i], parts[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = m & _ID_MASK, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in parts if x >= 0]

    def _plain(self, text: str) -> Iterator[list[int]]:
        """Ids of a text without special tokens."""
        if len(text) < LONG_TEXT:
            yield list(chain.from_iterable(map(self.words.__getitem__, self.split.findall(text))))
            return
        found = (m.group() for m in self.split.finditer(text))
        while part := list(islice(found, CHUNK_WORDS)):
            yield list(chain.from_iterable(map(self.words.__getitem__, part)))

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text, a stretch at a time, so that a very long text is never held as ids whole."""
        for piece in self.by_special.split(text or "") if self.by_special else [text or ""]:
            if piece in self.special:
                yield [self.special[piece]]
            elif piece:
                yield from self._plain(piece)

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; ids that the vocabulary lacks have none."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [x for x in batch.schema.names if x != name]
    return pa.record_batch([*[batch[x] for x in names], values], names=[*names, name])


def _schema(df: DataFrame, name: str, kind: str) -> str:
    kept = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name != name]
    return ", ".join([*kept, f"`{name}` {kind}"])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of ``text`` as an array; a null or empty text has none.

    Special tokens of the file that stand in a text are encoded as such; nothing else is added, cut or
    filled up. A column of the name ``ids`` is replaced; all others are kept. Each row is worked on by
    itself: no shuffle, and a lost executor's rows are simply encoded again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = [np.fromiter(chain.from_iterable(c.encode(t.as_py())), dtype=np.int32) for t in batch[text]]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            yield _with(batch, ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    return df.mapInArrow(run, _schema(df, ids, "array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of the ids; null ids give an empty text, broken UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = [c.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch[ids]]
            yield _with(batch, text, pa.array(rows, pa.string()))

    return df.mapInArrow(run, _schema(df, text, "string"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number and digest of its ids, and the digest of what they decode to.

    Rows stand for themselves: repeated rows give repeated results, a null doc_id stays null, other
    columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for value in batch["text"]:
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for ids in c.encode(value.as_py()):
                    if n and ids:
                        of_ids.update(b",")
                    of_ids.update(b",".join(map(c.digits_of.__getitem__, ids)))
                    of_text.update(c.decode(ids))
                    n += len(ids)
                counts.append(n)
                id_digests.append(of_ids.hexdigest())
                text_digests.append(of_text.hexdigest())
            yield pa.record_batch(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
