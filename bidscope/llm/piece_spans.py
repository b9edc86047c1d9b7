"""SentencePiece encoding that keeps every piece's place in the original bytes, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the model file's format.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2

NONE = -float("inf")
SHORT_WORD = 128  # characters; longer words are merged through a heap
CACHED_WORDS = 1 << 19  # words whose pieces a worker keeps; the store is emptied when full
CHUNK = 1 << 18  # characters of a text that are encoded at a time

Word = tuple[bytes, bytes, bytes]  # ids and how many characters each covers, as <u4, and what the ids decode to


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at, n = 0, len(message)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < n:
        tag = varint()
        size = {0: 0, 1: 8, 5: 4}.get(tag & 7, -1)
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if size < 0 else size
            yield tag >> 3, message[at : at + size]
            at += size


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 keys, and the texts that replace them."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]
        self.firsts = bytes(b for b in range(256) if self._child(self._root(), b)) if self.units else b""
        self.untouched = re.compile(b"[^" + re.escape(self.firsts) + b"]+", re.S) if self.firsts else re.compile(b".+", re.S)

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _child(self, node: int, byte: int) -> int:
        """The unit that a byte leads to, 0 if there is none."""
        at = node ^ byte
        unit = self.units[at] if at < len(self.units) else 0
        return unit if unit & 0x800000FF == byte else 0

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest key that stands at a place: its length and what replaces it."""
        node, found = self._root(), None
        for i in range(at, len(data)):
            unit = self._child(node, data[i])
            if not unit:
                break
            node ^= data[i] ^ self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found

    def parts(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        """The normalised text in parts, each with the source range it stands for; a part that the map
        leaves alone may be long and is then aligned byte by byte."""
        at = 0
        while at < len(data):
            if m := self.untouched.match(data, at):
                yield m.group(), at, m.end()
                at = m.end()
            elif found := self.longest(data, at):
                yield found[1], at, at + found[0]
                at += found[0]
            else:  # one character that is no key
                end = at + 1
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                yield data[at:end], at, end
                at = end


class _Store(dict):
    """Pieces by word, made when first asked for."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> Word:
        value = self.make(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


class Model:
    """A model file of kind BPE: normalises, encodes with source ranges, and decodes."""

    def __init__(self, raw: bytes) -> None:
        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        rules: dict = {}
        for number, value in fields(raw):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        self.kinds = [kind for _, _, kind in pieces]
        if pieces and (trainer.get(3) != BPE_MODEL or trainer.get(24) or {USER_DEFINED, UNUSED} & set(self.kinds)):
            raise ValueError("only BPE models with whitespace before words and without user-defined or unused pieces")
        self.map = CharacterMap(rules.get(2, b""))
        self.prefix, self.tidy, self.escape = bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))
        self.space = SPACE if self.escape else " "
        self.scores = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.of_byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.of_byte.items()}
        self.fallback = bool(trainer.get(35)) and len(self.of_byte) == 256
        self.unknown = next((i for i, kind in enumerate(self.kinds) if kind == UNKNOWN), 0)
        named = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.begin = named.get(trainer.get(46, b"<s>").decode())
        self.end = named.get(trainer.get(47, b"</s>").decode())
        surface = trainer.get(44, " ⁇ ".encode())
        self.surface = [
            b"" if kind == CONTROL else surface if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in pieces
        ]
        # If no piece holds a space behind another character, nothing is ever merged across the start of a word.
        splits = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.word = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if splits and self.escape else "(?s:.+)")
        self.cut = re.compile(f"(?<![ {SPACE}])[ {SPACE}]") if splits and self.escape else re.compile(r"(?!)")
        self.words = _Store(self.merge)

    # --- normalisation

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        return (text.replace(" ", SPACE) if self.escape else text), sizes

    def normalise(self, text: str) -> Iterator[tuple[str, np.ndarray]]:
        """The normalised text in stretches that can be encoded by themselves, and where in the source's bytes
        each of its characters begins; one more number tells where the last one ends.

        A map without entries changes nothing but spaces, so long texts go a stretch at a time. Otherwise each
        place takes the longest key of the map; all characters that replace a key stand where it begins.
        """
        if not text:
            return
        if not self.map.firsts and not self.tidy:
            at = done = 0
            while at < len(text):
                m = self.cut.search(text, at + CHUNK) if at + CHUNK < len(text) else None
                end = m.start() if m else len(text)
                own, sizes = self._plain(text[at:end])
                if not at and self.prefix:
                    own, sizes = self.space + own, np.insert(sizes, 0, 0)
                bounds = done + np.concatenate([[0], np.cumsum(sizes)])
                yield own, bounds
                at, done = end, int(bounds[-1])
            return
        out: list[str] = []
        starts: list[np.ndarray] = []
        data, done = text.encode(), 0
        blank = self.tidy  # whether the last character was a space, as it counts to be at the start
        for part, start, end in self._tidied(data):
            own = part.decode()
            if blank and self.tidy:
                own = own.lstrip(" ")
            done = end
            if own:
                same = part == data[start:end]
                kept, blank = len(own.encode()), own[-1] == " "
                own, sizes = self._plain(own)
                first = end - kept if same else start
                out.append(own)
                starts.append(first + np.cumsum(sizes) - sizes if same else np.full(len(own), start))
        whole = "".join(out)
        begins = np.concatenate([*starts, [done]]) if starts else np.array([done])
        if self.tidy and whole.endswith(self.space):
            whole = whole.rstrip(self.space)
            begins = begins[: len(whole) + 1]
        if not whole:
            return
        if self.prefix:
            whole, begins = self.space + whole, np.insert(begins, 0, begins[0])
        yield whole, begins

    def _tidied(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        """Parts of the map, cut where a space follows another, so that runs of spaces can be dropped one by one."""
        for part, start, end in self.map.parts(data):
            if self.tidy and end - start == len(part) and b"  " in part:
                at = start
                for own in re.split(rb"(?<= )(?= )", part):
                    yield own, at, at + len(own)
                    at += len(own)
            else:
                yield part, start, end

    # --- encoding

    def merge(self, word: str) -> Word:
        """Pieces of a stretch that nothing is merged across: the pair of the best score first, the leftmost of equals."""
        parts = self._merge_long(word) if len(word) > SHORT_WORD else self._merge_short(word)
        ids = [*map(self.ids.get, parts)]
        if None not in ids:
            return array("I", ids).tobytes(), array("I", map(len, parts)).tobytes(), b"".join([self.surface[i] for i in ids])
        every: list[int] = []
        counts: list[int] = []
        for p, i in zip(parts, ids):
            if i is not None or not self.fallback:
                every.append(self.unknown if i is None else i)
                counts.append(len(p))
            else:  # the bytes of a character that is no piece; the last one stands for it
                own = [self.of_byte[b] for b in p.encode()]
                every += own
                counts += [0] * (len(own) - 1) + [len(p)]
        text = b"".join(Decoder(self, at_start=False).feed(every, True))
        return array("I", every).tobytes(), array("I", counts).tobytes(), text

    def _merge_short(self, word: str) -> list[str]:
        get = self.scores.get
        parts = list(word)
        scores = [get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) != NONE:
            i = scores.index(best)
            joined = parts[i] + parts[i + 1]
            parts[i : i + 2] = [joined]
            del scores[i]
            if i < len(scores):
                scores[i] = get(joined + parts[i + 1], NONE)
            if i:
                scores[i - 1] = get(parts[i - 1] + joined, NONE)
        return parts

    def _merge_long(self, word: str) -> list[str]:
        get, n = self.scores.get, len(word)
        parts = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (s := get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-s, i, parts[i], parts[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def stretches(self, text: str | None) -> Iterator[tuple[list[Word], np.ndarray]]:
        """The words of a text, a stretch at a time, and where each of its characters begins in the source."""
        for own, source in self.normalise(text or ""):
            yield list(map(self.words.__getitem__, self.word.findall(own))), source

    @staticmethod
    def placed(found: list[Word], source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The begin and end in the source of each piece of a stretch's words."""
        counts = np.frombuffer(b"".join([x[1] for x in found]), "<u4")
        at = source[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return at[:-1], at[1:]

    def encode(self, text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, and the begin and end in the source's UTF-8 bytes of each, a stretch of the text at a time.

        Only the last byte piece of a character has a range; those before it are empty at its begin.
        """
        for found, source in self.stretches(text):
            yield np.frombuffer(b"".join([x[0] for x in found]), "<u4").astype(np.int64), *self.placed(found, source)

    # --- decoding

    def decode(self, ids: Iterable[int]) -> bytes:
        """The UTF-8 text of ids: without control pieces and the space put before the text; bytes that are
        no UTF-8 become replacement characters."""
        return b"".join(Decoder(self).feed(ids, True))


class Decoder:
    """Decodes ids as they come, keeping back the bytes of a character that may not be whole."""

    def __init__(self, model: Model, at_start: bool = True) -> None:
        self.model = model
        self.at_start = at_start
        self.held = bytearray()

    def _bytes(self) -> list[bytes]:
        """What the gathered byte pieces stand for, broken bytes one by one."""
        out, raw = [], bytes(self.held)
        while raw:
            try:
                raw.decode()
                out.append(raw)
                break
            except UnicodeDecodeError as e:
                out += [raw[: e.start], "�".encode()]
                raw = raw[e.start + 1 :]
        self.held.clear()
        return out

    def feed(self, ids: Iterable[int], last: bool = False) -> list[bytes]:
        model, out = self.model, []
        surface, byte_of, kinds = model.surface, model.byte_of, model.kinds
        for i in ids:
            if i in byte_of:
                self.held.append(byte_of[i])
                continue
            if self.held:
                out += self._bytes()
                self.at_start = False
            own = surface[i]
            if self.at_start and kinds[i] != CONTROL:
                if kinds[i] == NORMAL and (model.prefix or model.tidy) and own[:1] == b" ":
                    own = own.lstrip(b" ") if model.tidy else own[1:]
                    self.at_start = model.tidy and not own
                else:
                    self.at_start = False
            out.append(own)
        if last and self.held:
            out += self._bytes()
        return out


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(df: DataFrame, path: str, text: str = "text", pieces: str = "pieces") -> DataFrame:
    """Adds the pieces of ``text``: an array of (id, begin, end), the range in the text's UTF-8 bytes.

    Null and empty texts have none. No begin or end ids are put in. A column of the name ``pieces`` is
    replaced, all others are kept. Each row is worked on by itself: no shuffle, and a lost executor's rows
    are simply encoded again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            rows = [list(zip(*map(np.concatenate, zip(*found)))) if (found := list(m.encode(t.as_py()))) else [] for t in batch[text]]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = np.array([x for row in rows for x in row], np.int64).reshape(-1, 3)
            parts = [pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1]), pa.array(flat[:, 2])]
            values = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names=["id", "begin", "end"]))
            names = [x for x in batch.schema.names if x != pieces]
            yield pa.record_batch([*[batch[x] for x in names], values], names=[*names, pieces])

    kept = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name != pieces]
    name = pieces.replace("`", "``")
    return df.mapInArrow(run, ", ".join([*kept, f"`{name}` array<struct<id:int,begin:bigint,end:bigint>>"]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number and digest of its ids, begin and end ids included, the digest of what they
    decode to, and ``spans_sha256``, that of the pieces' (begin, end) as little-endian unsigned 64-bit numbers.

    Rows stand for themselves: a null text is empty, repeated rows give repeated results, a null doc_id
    stays null, other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        begin, end = ([i] if i is not None else [] for i in (m.begin, m.end))
        for batch in batches:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "spans_sha256": []}
            for value in batch["text"]:
                of_ids, of_text, of_spans = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
                n = len(begin) + len(end)
                of_ids.update(np.array(begin, "<u4").tobytes())
                decoder = Decoder(m)
                for found, source in m.stretches(value.as_py()):
                    ids = b"".join([x[0] for x in found])
                    n += len(ids) // 4
                    of_ids.update(ids)
                    of_spans.update(np.column_stack(m.placed(found, source)).astype("<u8", copy=False).tobytes())
                    # byte pieces never leave a word's characters open, so words decode by themselves but for the first
                    first = 0
                    while decoder.at_start and first < len(found):
                        of_text.update(b"".join(decoder.feed(np.frombuffer(found[first][0], "<u4").tolist())))
                        first += 1
                    of_text.update(b"".join(decoder.feed([], True)))
                    of_text.update(b"".join([x[2] for x in found[first:]]))
                of_ids.update(np.array(end, "<u4").tobytes())
                for name, x in zip(out, (n, of_ids.hexdigest(), of_text.hexdigest(), of_spans.hexdigest())):
                    out[name].append(x)
            yield pa.record_batch([batch["doc_id"], *map(pa.array, out.values())], names=["doc_id", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    )
