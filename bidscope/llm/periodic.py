"""Periodic runs of words: online dynamic programming over sparse diagonals.

A cell (word, lag) of the diagonal table is alive where the word stands at that lag before; its value, the
length of the match so far, is one more than that of the cell before it on the same diagonal. When a
diagonal ends, its length tells whether it is a run.

With all earlier occurrences of every word the alive cells of ``the the the ...`` would be quadratic in
number. Therefore stretches of k = 1, 2, 4, ... words take the place of single words, and each looks back to
its nearest earlier occurrence only; a diagonal counts at the step with k / 2 < lag <= k. Nothing is lost, as

* in a run of smallest period q a stretch of at least q words occurs next at lag q exactly (it would otherwise
  hold a shorter period), and a run of 3 q words has room for stretches of k < 2 q words at lag q;
* for the same reason a diagonal of 3 q words found like this has no shorter period and cannot be extended.

Each step numbers its stretches by the pairs of numbers of their halves, so that equal numbers are equal
words and nothing rests on hashes. Only stretches whose halves occur twice are looked at again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_WORDS = 24  # of a run
LEAST_PERIODS = 3  # of a run; the proofs above need 3 at least
SLICE_WORDS = 1 << 18  # words of several texts that are worked on together; a longer text goes by itself

Run = tuple[int, int, int]  # start, length, period


def _look_back(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places and their numbers: the distance to the nearest earlier place of the same number (0: none),
    and which of them occur more than once."""
    order = np.argsort(ids, kind="stable")  # places are ascending, so equal numbers stay in order
    same = ids[order][1:] == ids[order][:-1]
    lags = np.zeros(len(ids), np.int64)
    lags[order[1:]] = np.where(same, np.diff(at[order]), 0)
    twice = np.zeros(len(ids), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return lags, twice


def _diagonals(lags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First place, number of cells and lag of each diagonal: cells that follow each other at the same lag."""
    alive = np.flatnonzero(lags)
    if not len(alive):
        return np.zeros((0, 3), np.int64)
    lag, place = lags[alive], at[alive]
    ends = np.flatnonzero(np.append((np.diff(lag) != 0) | (np.diff(place) != 1), True))
    starts = np.append(0, ends[:-1] + 1)
    return np.column_stack([place[starts], ends - starts + 1, lag[starts]])


def runs(ids: np.ndarray, longest: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of numbers, by start and period.

    ``longest`` bounds the length of a run, as where several texts without common numbers stand behind each other.
    """
    if least_periods < 3:
        raise ValueError("runs of less than three periods are not found this way")
    at = np.arange(len(ids))
    own, k = np.unique(ids, return_inverse=True)[1] if len(ids) else ids, 1
    found: list[np.ndarray] = []
    while len(at) and least_periods * (k // 2 + 1) <= longest:
        lags, twice = _look_back(own, at)
        start, cells, lag = _diagonals(np.where((lags > k // 2) & (lags <= k), lags, 0), at).T
        length = cells + k - 1 + lag
        good = length >= np.maximum(least_words, least_periods * lag)
        found.append(np.column_stack([start - lag, length, lag])[good])
        # a stretch of 2 k words is the pair of its halves, both of which must occur twice
        at, own = at[twice], own[twice]
        second = np.searchsorted(at, at + k)
        pair = np.flatnonzero((second < len(at)) & (at[np.minimum(second, len(at) - 1)] == at + k)) if len(at) else at
        codes = own[pair] * (int(own.max(initial=0)) + 1) + own[second[pair]]
        at, own = at[pair], np.unique(codes, return_inverse=True)[1]
        k *= 2
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the contract alters them: the tail of one document in ten repeats itself."""
    h, n = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // len(tail) + 1))[: n - a]


def _texts(doc_ids: pa.Array, texts: pa.Array, alter: bool) -> Iterator[list[list[bytes]]]:
    """The words of texts, several together."""
    held: list[list[bytes]] = []
    size = 0
    for doc_id, text in zip(doc_ids, texts):
        words = (text.as_py() or "").encode().split()
        words = repeated(words, doc_id.as_py()) if alter else words
        if held and size + len(words) > SLICE_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text. Texts are numbered apart, so that nothing matches across them."""
    ids = np.empty(sum(map(len, texts)), np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    used = 0
    for words, start in zip(texts, bounds):
        number: dict[bytes, int] = {}
        ids[start : start + len(words)] = [number.setdefault(x, len(number)) for x in words]
        ids[start : start + len(words)] += used
        used += len(number)
    every = runs(ids, max(map(len, texts)))
    parts = np.split(every, np.searchsorted(every[:, 0], bounds[1:-1]))
    return [part - np.array([start, 0, 0]) for part, start in zip(parts, bounds)]


def strongest(found: list[Run]) -> Run | None:
    """The run of greatest length by period, compared exactly; of equals the first, then that of the shortest period."""
    best = None
    for run in found:
        if best is None or (x := run[1] * best[2] - best[1] * run[2]) > 0 or x == 0 and run[::2] < best[::2]:
            best = run
    return best


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(found).T
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return [words[i] for i in keep]


_RESULT = {
    "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(), "collapsed_sha256": pa.string(),
}


def digests(docs: DataFrame, alter: bool = True) -> DataFrame:
    """Per document its runs in short (see the contract) and the digest of the text without repetitions.

    Null and empty texts have no words and no runs. ``alter`` first makes the tail of one document in ten
    repeat itself; a null doc_id is never altered. Rows stand for themselves: repeated rows give repeated
    results, other columns are left out. No shuffle; a lost executor's rows are simply worked on again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {x: [] for x in _RESULT}
            for texts in _texts(batch["doc_id"], batch["text"], alter):
                for words, every in zip(texts, _runs_of(texts)):
                    found = [tuple(x) for x in every.tolist()]
                    best = strongest(found)
                    lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
                    out["n_runs"].append(len(found))
                    for name, x in zip(("start", "length", "period"), best or (None,) * 3):
                        out[name].append(x)
                    out["exponent_milli"].append(1000 * best[1] // best[2] if best else None)
                    out["runs_sha256"].append(hashlib.sha256(lines.encode()).hexdigest())
                    out["collapsed_sha256"].append(hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())
            columns = [batch["doc_id"], *(pa.array(out[x], kind) for x, kind in _RESULT.items())]
            yield pa.record_batch(columns, names=["doc_id", *_RESULT])

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = ", ".join(f"{x} {'string' if x.endswith('sha256') else 'bigint'}" for x in _RESULT)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {kinds}")


def without_repetitions(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``text`` reduced to one period where words repeat periodically; other texts, null ones
    included, stay as they are. All columns are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list[str | None] = []
            for texts in _texts(pa.nulls(len(batch)), batch[text], False):
                for words, every in zip(texts, _runs_of(texts)):
                    found = [tuple(x) for x in every.tolist()]
                    values.append(b" ".join(collapsed(words, found)).decode() if found else batch[text][len(values)].as_py())
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array(values, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def runs_of(docs: DataFrame, text: str = "text", name: str = "runs") -> DataFrame:
    """The rows with the runs of ``text`` as an array of (start, length, period), empty without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [x for texts in _texts(pa.nulls(len(batch)), batch[text], False) for x in _runs_of(texts)]
            ends = np.cumsum([0, *map(len, every)]).astype(np.int32)
            flat = np.concatenate(every) if every else np.zeros((0, 3), np.int64)
            fields = pa.StructArray.from_arrays([pa.array(x) for x in flat.T], names=["start", "length", "period"])
            kept = [x for x in batch.schema.names if x != name]
            yield pa.record_batch([*(batch[x] for x in kept), pa.ListArray.from_arrays(pa.array(ends), fields)], names=[*kept, name])

    kept = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema if f.name != name]
    own = name.replace("`", "``")
    return docs.mapInArrow(run, ", ".join([*kept, f"`{own}` array<struct<start:bigint,length:bigint,period:bigint>>"]))
