"""Benchmark decontamination by template windows with slot consistency.

Numbers, names and units become typed placeholders. Windows of template tokens are joined by hash with
those of the benchmark; along every run of matching windows the placeholders' values must map one to one
between benchmark and document, which also holds for questions with other values put in. Runs of names and
of numbers with units are also taken as one placeholder each, so that values of another length match, and
windows of too few other words for a template are compared as they stand.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from bidscope.llm.hashing import PrefixHash, byte_values, mix, slices

WINDOW = 13  # template tokens
MIN_LITERALS = 6  # tokens of a window that are no placeholders
MIN_ITEM = 5  # shorter items count where they are a whole sentence or line: inside others they would be found everywhere
MAX_ODD = 0.2  # share of a run's slots that may break the one-to-one mapping
BLOCK_BYTES = 16 << 20  # benchmark text that is held at a time; a longer benchmark is taken in blocks

# Words read as units when a number stands before them.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg t ton tons tonne tonnes ounce ounces pound pounds lb lbs "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years percent degree degrees dollar dollars euro euros cent cents usd eur gbp v w kw kwh hz khz mhz ghz "
    "kb mb gb tb km/h mph"
).split()

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x6E756D626572, 0x6E616D65, 0x756E6974))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = True
_INSIDE = np.zeros(256, bool)  # part of a number between two digits
_INSIDE[[44, 46]] = True
_BREAK = np.zeros(256, bool)  # ends a sentence or line, where it is not inside a number
_BREAK[[10, 13, 33, 46, 58, 59, 63]] = True

# How tokens are compared: names and numbers as placeholders; numbers alone, so that copies that differ in
# case match too; both with runs of placeholders as one; word by word.
KINDS = ("names", "numbers", "name runs", "number runs", "exact")


@dataclass
class View:
    """Texts in one of the ``KINDS``: tokens, which of them are placeholders, their values, the texts' bounds, and
    each one's first token in the text (with the end of the last)."""

    template: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    bounds: np.ndarray
    first: np.ndarray


@dataclass
class Tokens:
    """Tokens of several texts: value, kind (0 literal, 1 number, 2 name, 3 unit), the texts' first tokens, and
    whether a sentence or line begins with the token (or the end)."""

    value: np.ndarray
    slot: np.ndarray
    bounds: np.ndarray
    fresh: np.ndarray

    def view(self, kind: str) -> View:
        """The tokens with placeholders in place of slots; in "exact" nothing is one."""
        n = len(self.value)
        if kind == "exact":
            return View(self.value, np.zeros(n, bool), self.value, self.bounds, np.arange(n + 1))
        slot = self.slot if kind.startswith("name") else np.where(self.slot == 2, 0, self.slot)
        if not kind.endswith("runs"):
            template = np.select([slot == 1, slot == 2, slot == 3], [_NUMBER, _NAME, _UNIT], self.value)
            return View(template, slot > 0, self.value, self.bounds, np.arange(n + 1))
        slot = np.where(slot == 3, 1, slot)
        begins = np.ones(n + 1, bool)
        begins[1:n] = (slot[1:] == 0) | (slot[1:] != slot[:-1])
        begins[self.bounds] = True
        first = np.flatnonzero(begins)
        slot = slot[first[:-1]]
        value = mix(PrefixHash(self.value).of(first[:-1], first[1:]))
        template = np.select([slot == 1, slot == 2], [_NUMBER, _NAME], self.value[first[:-1]])
        return View(template, slot > 0, value, np.searchsorted(first, self.bounds), first)


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Template tokens of concatenated texts: runs of letters and digits, in lower case.

    A token with a digit is a number ("1,000" is one), a token that begins with a capital is a name, a
    unit word after a number is a unit. Punctuation, spacing and case of other words do not count.
    """
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], after[:-1] = data[:-1], data[1:]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = np.zeros(n + 1, bool)
    word[:-1] = _DIGIT[data] | _LETTER[data] | (_INSIDE[data] & _DIGIT[before] & _DIGIT[after] & ~edge[:-1] & ~edge[1:])
    left = np.zeros(n + 1, bool)
    left[1:] = word[:-1]
    starts, ends = np.flatnonzero(word & (~left | edge)), np.flatnonzero(left & (~word | edge))
    latin = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    lower = data + np.where(((data >= 65) & (data <= 90)) | latin, 32, 0).astype(np.uint8)
    value = mix(PrefixHash(byte_values(lower)).of(starts, ends) + (ends - starts).astype(np.uint64))
    digits = np.zeros(n + 1, np.int64)
    np.cumsum(_DIGIT[data], out=digits[1:])
    number = digits[ends] > digits[starts]
    name = ((data[starts] >= 65) & (data[starts] <= 90)) | ((data[starts] == 0xC3) & latin[np.minimum(starts + 1, n - 1)]) if len(starts) else number
    bounds = np.searchsorted(starts, offsets)
    breaks = np.zeros(n + 1, np.int64)
    np.cumsum(_BREAK[data], out=breaks[1:])
    fresh = np.ones(len(starts) + 1, bool)
    fresh[1:-1] = breaks[starts[1:]] > breaks[ends[:-1]]
    fresh[bounds] = True
    after_number = np.zeros(len(starts), bool)
    after_number[1:] = number[:-1]
    after_number[bounds[:-1][bounds[:-1] < len(starts)]] = False
    unit = after_number & np.isin(value, _UNIT_VALUES) & ~number
    slot = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0))).astype(np.int8)
    return Tokens(value, slot, bounds, fresh)


_UNIT_VALUES = np.zeros(0, np.uint64)
_unit_text = np.frombuffer(" ".join(u for u in UNITS if "/" not in u).encode(), np.uint8)
_UNIT_VALUES = tokens(_unit_text, np.array([0, len(_unit_text)])).value


@dataclass
class Benchmark:
    """Benchmark items with their windows by kind and length, sorted by hash."""

    ids: list
    views: dict[str, View]
    windows: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]  # kind, length: hashes, first tokens


def _windows(part: Tokens, view: View, kind: str, length: int, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of the windows of a length that lie in one text.

    Templates need enough literals. Of the exact windows, those of full length are the ones that have
    not enough of them (benchmark: ``own``) or one more, as a unit shows by the number before it; those
    of items too short for windows are whole sentences or lines.
    """
    at = np.arange(max(0, len(view.template) - length + 1))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    need = min(MIN_LITERALS, (length + 1) // 2)
    if kind != "exact" or length == WINDOW:
        slot = view.slot if kind != "exact" else part.view("numbers").slot
        literals = np.concatenate([[0], np.cumsum(~slot)])
        literals = literals[at + length] - literals[at]
        at = at[literals >= need if kind != "exact" else literals < need + (not own)]
    elif length < MIN_ITEM and not own:
        at = at[part.fresh[at] & part.fresh[at + length]]
    text = np.searchsorted(view.bounds, at, side="right") - 1
    at = at[at + length <= view.bounds[text + 1]]
    return at, mix(PrefixHash(view.template).of(at, at + length))


def benchmark_of(items: list[tuple]) -> Benchmark:
    texts = [(text or "").encode() for _, text in items]
    data = np.frombuffer(b"".join(texts), np.uint8)
    part = tokens(data, np.cumsum([0, *map(len, texts)]))
    views = {kind: part.view(kind) for kind in KINDS}
    windows = {}
    for kind, view in views.items():
        sizes = np.diff(view.bounds)
        text_of = np.repeat(np.arange(len(items)), sizes)
        shortest = 1 if kind == "exact" else MIN_ITEM
        for length in sorted({min(WINDOW, int(n)) for n in sizes if n >= shortest}):
            at, hashes = _windows(part, view, kind, length, own=True)
            own = np.minimum(sizes[text_of[at]], WINDOW) == length
            at, hashes = at[own], hashes[own]
            if kind == "exact":  # an item's equal windows tell nothing more
                _, once = np.unique(np.stack([hashes, text_of[at].astype(np.uint64)]), axis=1, return_index=True)
                at, hashes = at[np.sort(once)], hashes[np.sort(once)]
            order = np.argsort(hashes, kind="stable")
            if len(order):
                windows[kind, length] = hashes[order], at[order]
    return Benchmark([i for i, _ in items], views, windows)


def _consistent(doc: np.ndarray, item: np.ndarray, slot: np.ndarray) -> bool:
    """Whether the slots' values map one to one along a run, but for a few.

    Each value's commonest partner counts as its mapping, in both directions.
    """
    pairs = Counter(zip(doc[slot].tolist(), item[slot].tolist()))
    to_item: dict[int, int] = {}
    to_doc: dict[int, int] = {}
    for (a, b), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        to_item.setdefault(a, b)
        to_doc.setdefault(b, a)
    odd = sum(n for (a, b), n in pairs.items() if to_item[a] != b or to_doc[b] != a)
    return odd <= MAX_ODD * sum(pairs.values())


def matches(part: Tokens, bench: Benchmark) -> list[tuple]:
    """(text, item, first token, tokens, slots, changed slots) of every accepted run of matching windows.

    Runs of the later kinds are left out where an earlier kind's run of the same item holds them.
    """
    found: dict[tuple[int, int, int], tuple] = {}
    more: dict[tuple[int, int], list[tuple]] = {}
    views = {kind: part.view(kind) for kind in {kind for kind, _ in bench.windows}}
    for (kind, length), (hashes, places) in bench.windows.items():
        view, items = views[kind], bench.views[kind]
        at, mine = _windows(part, view, kind, length)
        low, high = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        doc_at = np.repeat(at[hit], counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        item_at = places[np.repeat(low[hit], counts) + step]
        order = np.lexsort((doc_at, doc_at - item_at))
        doc_at, item_at = doc_at[order], item_at[order]
        text = np.searchsorted(view.bounds, doc_at, side="right") - 1
        item = np.searchsorted(items.bounds, item_at, side="right") - 1
        new = np.ones(len(doc_at), bool)
        new[1:] = (np.diff(doc_at) > length) | (np.diff(doc_at - item_at) != 0) | (np.diff(text) != 0) | (np.diff(item) != 0)
        edges = np.append(np.flatnonzero(new), len(doc_at))
        for a, b in zip(edges[:-1], edges[1:]):
            i, j, size = int(doc_at[a]), int(item_at[a]), int(doc_at[b - 1] - doc_at[a]) + length
            slot = items.slot[j : j + size]
            inner = slot.copy()
            if kind.endswith("runs"):  # what stands beside the run may be part of its outer placeholders
                inner[[0, -1]] = False
            doc_values, item_values = view.value[i : i + size], items.value[j : j + size]
            if not _consistent(doc_values, item_values, inner):
                continue
            t, x = int(text[a]), int(item[a])
            first, last = int(view.first[i]), int(view.first[i + size])
            changed = int((doc_values != item_values)[slot].sum())
            run = (t, x, first - int(part.bounds[t]), last - first, int(slot.sum()), changed)
            if kind in ("names", "numbers"):
                found[t, x, i - j] = max(found.get((t, x, i - j), run), run, key=lambda r: r[3])
            else:
                more.setdefault((t, x), []).append(run)
    held: dict[tuple[int, int], list[tuple]] = {}
    for run in found.values():
        held.setdefault(run[:2], []).append(run)
    for key, runs in more.items():
        known = held.setdefault(key, [])
        for run in runs:
            if not any(r[2] <= run[2] and run[2] + run[3] <= r[2] + r[3] for r in known):
                known.append(run)
    return sorted(run for runs in held.values() for run in runs)


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size, whatever its length."""
    block, held = [], 0
    for row in benchmark.select(item, text).orderBy(item, text).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1] or "") + 64
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _search(column: pa.Array, bench: Benchmark) -> Iterator[tuple]:
    for row, _, data, offsets in slices(column):
        for text, *rest in matches(tokens(data, offsets), bench):
            yield row + text, *rest


def contaminations(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, first_token, n_tokens, n_slots, n_changed`` of every run a document shares with an item.

    A document without such a run has no row. Null and empty texts match nothing; repeated documents and
    repeated items give repeated rows; items of fewer than ``MIN_ITEM`` tokens are found as a whole sentence or
    line. The documents are streamed past each block of the benchmark, without a shuffle.
    """
    kind = {c: d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, item))}
    schema = f"doc_id {kind['doc_id']}, item_id {kind[item]}, first_token bigint, n_tokens bigint, n_slots bigint, n_changed bigint"
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    result = None
    for block in _blocks(benchmark, item, text):
        bench = benchmark_of(block)

        def run(batches: Iterator[pa.RecordBatch], bench: Benchmark = bench) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_search(batch["text"], bench))
                ids = batch["doc_id"].take(pa.array([r[0] for r in rows], pa.int64()))
                items = pa.array([bench.ids[r[1]] for r in rows], item_type)
                numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(2, 6)]
                yield pa.RecordBatch.from_arrays([ids, items, *numbers], names=["doc_id", "item_id", "first_token", "n_tokens", "n_slots", "n_changed"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def decontaminate(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The documents, all columns kept, that share no run with any item; rules as in ``contaminations``."""
    for block in _blocks(benchmark, item, text):
        bench = benchmark_of(block)

        def run(batches: Iterator[pa.RecordBatch], bench: Benchmark = bench) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in _search(batch["text"], bench)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
