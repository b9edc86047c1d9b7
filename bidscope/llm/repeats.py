"""Repeated windows across documents: how equal windows meet without comparing all texts.

Every window holds a chosen gram, its smallest hash (``hashing.anchors``); equal windows choose equal
grams. A gram's *context* is all windows that hold it. The jobs here

1. collapse equal contexts, first in each task, then by gram: but for the first, their windows are all
   repeats, so copies are settled without being compared;
2. bring the differing contexts of one gram together, with their text, as *stretches* of documents;
3. leave to a caller's method to find the equal windows inside such a shard of stretches.

A gram with very many differing contexts is split: its windows are divided by their place relative to
the gram, and each half gets a longer common core as its key, until the groups are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bidscope.llm import hashing
from bidscope.session import stage

GROUP_CONTEXTS = 2_048  # differing contexts of one key; beyond, the key is split
OPEN_ROWS = 1 << 19  # rows of one key that a task holds while it streams
NO_ID = -(1 << 63)

# What is sorted and shuffled by the million: ``place`` packs a context's start, length and gram.
_SLIM = {"key": pa.int64(), "content": pa.int64(), "doc": pa.int64(), "copy": pa.int64(), "place": pa.int64(), "n": pa.int32()}
_SPLIT = _SLIM | {"low": pa.int32(), "high": pa.int32(), "body": pa.binary()}
_OPEN = {
    "key": pa.int64(), "doc": pa.int64(), "copy": pa.int64(), "start": pa.int32(), "stop": pa.int32(),
    "anchor": pa.int32(), "low": pa.int32(), "high": pa.int32(), "body": pa.binary(),
}
_SPAN = {x: _OPEN[x] for x in ("doc", "copy", "start", "stop")}
_SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}

Method = Callable[["Shard"], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Windows:
    """What counts as a repeat: ``size`` units ("words" or "bytes") in a row, found by grams of ``gram``.

    Contexts of 2 * size - gram units must stay below 4,096, the room their packed form has.
    """

    unit: str
    size: int
    gram: int
    keep_first: bool  # the first of equal windows is no repeat
    shard_units: int  # units of text a method gets at a time, but for a single large key


@dataclass
class Shard:
    """Stretches of documents in order of (document, place): their bodies, and owner of each."""

    bodies: list[bytes]
    doc: np.ndarray
    copy: np.ndarray
    start: np.ndarray


# --- documents


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_doc, _copy, _text``: the number a document goes by, 0, and its text (null: empty);
    and each document's text once.

    Where ids repeat or are missing, ``_copy`` is the text's hash: rows equal in both are one document,
    others with the same id are documents that follow each other in the order of that hash; a missing
    id is before all others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    counts = docs.select(doc.alias("_doc")).groupBy("_doc").agg(F.count(F.lit(1)).alias("_n"))
    unclear = not counts.filter((F.col("_n") > 1) | (F.col("_doc") == NO_ID)).isEmpty()
    copy = F.xxhash64(text) if unclear else F.lit(0).cast("long")
    rows = docs.select("*", doc.alias("_doc"), copy.alias("_copy"), text.alias("_text"))
    texts = rows.select("_doc", "_copy", "_text")
    return rows, texts.dropDuplicates(["_doc", "_copy"]) if unclear else texts


def units_of(unit: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the units of concatenated texts, and every text's first unit."""
    if unit == "bytes":
        return hashing.byte_values(data), offsets
    starts, ends, bounds = hashing.words(data, offsets)
    return hashing.word_hashes(data, starts, ends), bounds


def cut(unit: str, raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    """The bytes of ranges of units; words are joined by one space."""
    if unit == "bytes":
        return [raw[a:b] for a, b in spans]
    words = raw.split()
    return [b" ".join(words[a:b]) for a, b in spans]


# --- contexts


def _schema(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {_SQL[kind]}" for name, kind in fields.items())


def _batch(fields: dict[str, pa.DataType], columns: dict, n: int) -> pa.RecordBatch:
    """A batch of ``n`` rows; columns that are not given are null."""
    arrays = [pa.array(columns[x], t) if x in columns else pa.nulls(n, t) for x, t in fields.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(fields))


def _pack(start: np.ndarray, length: np.ndarray | int, anchor: np.ndarray | int) -> np.ndarray:
    return start.astype(np.int64) << 24 | length << 12 | anchor


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = place >> 24
    return start, start + (place >> 12 & 0xFFF), place & 0xFFF


def _joined(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of the same document that touch become one."""
    order = np.lexsort((stop, start, copy, doc))
    doc, copy, start, stop = doc[order], copy[order], start[order], stop[order]
    if not len(doc):
        return doc, copy, start, stop
    new_doc = np.ones(len(doc), bool)
    new_doc[1:] = (np.diff(doc) != 0) | (np.diff(copy) != 0)
    lift = np.cumsum(new_doc).astype(np.int64) << 40
    reach = np.maximum.accumulate(stop + lift) - lift  # furthest end so far in the document
    new = new_doc.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], copy[at], start[at], reach[last]


def _span_rows(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Settled repeats travel with the contexts under a key of their document: ``n`` is 0, ``content`` the end."""
    doc, copy, start, stop = _joined(doc, copy, start, stop)
    key = hashing.mix(doc.view(np.uint64)).view(np.int64)
    columns = {"key": key, "content": stop, "doc": doc, "copy": copy, "place": _pack(start, 0, 0), "n": np.zeros(len(doc))}
    return _batch(_SLIM, columns, len(doc))


def _contexts(w: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contexts of a task's documents; of equal ones only the first is sent on, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, copy = (np.asarray(batch[c], dtype=np.int64) for c in ("_doc", "_copy"))
            parts: list[dict] = []
            for row, end, data, offsets in hashing.slices(batch["_text"]):
                values, bounds = units_of(w.unit, data, offsets)
                found = hashing.anchors(values, bounds, w.gram, w.size)
                found["doc"], found["copy"] = doc[row:end][found["text"]], copy[row:end][found["text"]]
                parts.append(found)
            if not parts:
                continue
            c = {k: np.concatenate([p[k] for p in parts]) for k in ("key", "content", "doc", "copy", "start", "end", "at")}
            order = np.lexsort((c["start"], c["copy"], c["doc"], c["content"], c["key"]))
            c = {k: v[order] for k, v in c.items()}
            if not len(order):
                continue
            first = np.ones(len(order), bool)
            first[1:] = (np.diff(c["key"]) != 0) | (np.diff(c["content"]) != 0)
            at = np.flatnonzero(first)
            place = _pack(c["start"], c["end"] - c["start"], c["at"] - c["start"])
            columns = {"n": np.diff(np.append(at, len(order))), "place": place[at]} | {x: c[x][at] for x in ("key", "content", "doc", "copy")}
            yield _batch(_SLIM, columns, len(at))
            rest = ~first
            if rest.any():
                yield _span_rows(c["doc"][rest], c["copy"][rest], c["start"][rest], c["end"][rest])

    return run


def _settle(w: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams contexts in order of key, content and place; yields settled repeats (key null) and the first
    contexts of keys with several contents.

    Only the rows of the last key are held back for the next batch; a key with more than ``OPEN_ROWS`` is
    let go run by run.
    """

    def settled(rows: pa.Table, several: bool) -> Iterator[pa.RecordBatch]:
        """Yields what whole (key, content) runs give; ``several``: the first key has other contents too."""
        col = {x: np.asarray(rows[x]) for x in _SLIM}
        span = col["n"] == 0
        same_key = np.zeros(len(span), bool)
        same = np.zeros(len(span), bool)
        same_key[1:] = (np.diff(col["key"]) == 0) & ~span[1:] & ~span[:-1]
        same[1:] = same_key[1:] & (np.diff(col["content"]) == 0)
        run = np.cumsum(~same) - 1
        copies = np.bincount(run, weights=col["n"])[run]
        keys = np.cumsum(~same_key) - 1
        contents = np.bincount(keys, weights=~same)[keys]
        contents[keys == 0] += several
        start, stop, anchor = _unpack(col["place"])
        stop = np.where(span, col["content"], stop)
        repeat = span | same if w.keep_first else span | (copies > 1)
        if repeat.any():
            joined = _joined(*(x[repeat] for x in (col["doc"], col["copy"], start, stop)))
            yield _batch(_OPEN, dict(zip(_SPAN, joined)), len(joined[0]))
        open_ = ~span & ~same & (contents > 1)
        if open_.any():
            n = int(open_.sum())
            columns = {"start": start[open_], "stop": stop[open_], "anchor": anchor[open_]} | {x: col[x][open_] for x in ("key", "doc", "copy")}
            if "body" in rows.schema.names:
                columns |= {x: rows[x].filter(pa.array(open_)).combine_chunks() for x in ("low", "high", "body")}
            else:
                columns |= {"low": np.full(n, w.gram - w.size), "high": np.zeros(n)}
            yield _batch(_OPEN, columns, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        several = False
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            key, content, n = (np.asarray(rows[x]) for x in ("key", "content", "n"))
            last = int(np.flatnonzero(np.append(True, np.diff(key) != 0))[-1]) if len(key) else 0
            if last:
                yield from settled(rows.slice(0, last), several)
                rows, several = rows.slice(last), False
            elif len(key) > OPEN_ROWS and (n == 0).any():  # settled ranges of one document
                yield from settled(rows.filter(pa.array(n == 0)), False)
                rows = rows.filter(pa.array(n > 0))
            elif len(key) > OPEN_ROWS:
                turn = np.flatnonzero((np.diff(content) != 0) & (n[1:] > 0) & (n[:-1] > 0))
                if len(turn):  # whole runs go, the last one stays
                    at = int(turn[-1]) + 1
                    yield from settled(rows.slice(0, at), True)
                    rows, several = rows.slice(at), True
                else:  # one run: its first row stands for it
                    later = rows.slice(1)
                    start, stop, _ = _unpack(np.asarray(later["place"]))
                    joined = _joined(np.asarray(later["doc"]), np.asarray(later["copy"]), start, stop)
                    yield _batch(_OPEN, dict(zip(_SPAN, joined)), len(joined[0]))
                    total = pa.array([min(int(n.sum()), 1 << 30)], pa.int32())
                    rows = rows.slice(0, 1).set_column(rows.schema.get_field_index("n"), "n", total)
            held = rows
        if held is not None and len(held):
            yield from settled(held, several)

    return run


def _grouped(rows: DataFrame) -> DataFrame:
    """All rows of a key in one partition, in order; the engine's sort spills."""
    return rows.repartition(F.col("key")).sortWithinPartitions("key", "content", "doc", "copy", "place")


# --- splitting keys


def _halves(w: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Divides every context by its windows' places; the words or bytes that all windows of a half share
    become part of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                raw = r["body"]
                data = np.frombuffer(raw, np.uint8)
                values, _ = units_of(w.unit, data, np.array([0, len(raw)]))
                prefix, at = hashing.PrefixHash(values), r["anchor"]
                middle = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    a, b = max(0, at + low), min(len(values), at + high + w.size)
                    if low > high or at + high < 0 or at + low + w.size > len(values) or b - a < w.size:
                        continue
                    core = prefix.of(np.array([at + high]), np.array([at + low + w.size]))
                    whole = prefix.of(np.array([a]), np.array([b]))
                    tag = np.uint64((low & 0xFFFF) << 16 | (high & 0xFFFF))
                    key = hashing.mix(core + hashing.mix(np.array([r["key"]]).view(np.uint64) + tag))
                    content = hashing.mix(whole + np.uint64((at - a) << 32 | (b - a)))
                    out.append({
                        "key": key.view(np.int64)[0], "content": content.view(np.int64)[0], "doc": r["doc"], "copy": r["copy"],
                        "place": (r["start"] + a) << 24 | (b - a) << 12 | (at - a), "n": 1, "low": low, "high": high,
                        "body": cut(w.unit, raw, [(a, b)])[0],
                    })
            yield _batch(_SPLIT, {x: [o[x] for o in out] for x in _SPLIT}, len(out))

    return run


def _with_bodies(contexts: DataFrame, docs: DataFrame, w: Windows) -> DataFrame:
    """Contexts with their text, cut out of the documents by one join on the document."""
    fields = [x for x in _OPEN if x not in ("doc", "copy", "body")]
    wanted = contexts.groupBy(F.col("doc").alias("_doc"), F.col("copy").alias("_copy")).agg(F.collect_list(F.struct(*fields)).alias("_wanted"))
    joined = docs.join(wanted, ["_doc", "_copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[dict] = []
            size = 0
            for doc, copy, text, wanted in zip(*(batch[c] for c in ("_doc", "_copy", "_text", "_wanted"))):
                rows = wanted.as_py()
                bodies = cut(w.unit, text.as_py().encode(), [(r["start"], r["stop"]) for r in rows])
                for r, body in zip(rows, bodies):
                    held.append({**r, "doc": doc.as_py(), "copy": copy.as_py(), "body": body})
                    size += len(body) + 200
                if size > 16 << 20:
                    yield _batch(_OPEN, {x: [h[x] for h in held] for x in _OPEN}, len(held))
                    held, size = [], 0
            if held:
                yield _batch(_OPEN, {x: [h[x] for h in held] for x in _OPEN}, len(held))

    return joined.mapInArrow(run, _schema(_OPEN))


# --- shards


def _stretches(rows: list[tuple], unit: str) -> Shard:
    """Contexts (doc, copy, start, stop, body) of whole keys as stretches without overlap."""
    rows = sorted(set(rows))
    out: list[list] = []
    for doc, copy, start, stop, body in rows:
        if out and out[-1][:2] == [doc, copy] and start <= out[-1][3]:
            last = out[-1]
            if stop > last[3]:
                if unit == "bytes":
                    last[4].append(body[last[3] - start :])
                else:
                    last[4].append(b" ".join(body.split()[last[3] - start :]))
                last[3] = stop
        else:
            out.append([doc, copy, start, stop, [body]])
    join = b"" if unit == "bytes" else b" "
    number = lambda i: np.array([x[i] for x in out], np.int64)
    return Shard([join.join(x[4]) for x in out], number(0), number(1), number(2))


def _sharded(w: Windows, method: Method) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands whole keys to the method, several at a time, and yields the repeats it finds."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        shard = _stretches(rows, w.unit)
        which, starts, stops = method(shard)
        doc, copy, start, stop = _joined(shard.doc[which], shard.copy[which], shard.start[which] + starts, shard.start[which] + stops)
        return _batch(_SPAN, {"doc": doc, "copy": copy, "start": start, "stop": stop}, len(doc))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, key = 0, None
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("key", "doc", "copy", "start", "stop", "body"))
            for k, *row in zip(*columns):
                if k != key and held >= w.shard_units:
                    yield found(rows)
                    rows, held = [], 0
                key = k
                rows.append(tuple(row))
                held += row[3] - row[2]
        if rows:
            yield found(rows)

    return run


def repeated_spans(docs: DataFrame, w: Windows, method: Method) -> DataFrame:
    """``_doc, _copy, spans`` of the texts (see ``identified``) that hold repeats; ranges of units."""
    contexts = docs.mapInArrow(_contexts(w), _schema(_SLIM))
    rows = stage(_grouped(contexts).mapInArrow(_settle(w), _schema(_OPEN)), "contexts")
    spans = [rows.filter("key is null")]
    open_rows = rows.filter("key is not null")
    ready: list[DataFrame] = []
    with_body = False
    while True:
        sizes = open_rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
        large = stage(sizes.filter(F.col("_n") > GROUP_CONTEXTS).select("key"), "large-keys")
        split = not large.isEmpty()
        small = open_rows.join(large, "key", "left_anti") if split else open_rows
        ready.append(small)
        if not split:
            break
        hot = open_rows.join(large, "key", "left_semi")
        hot = hot if with_body else _with_bodies(hot, docs, w)
        halves = hot.select(*_OPEN).mapInArrow(_halves(w), _schema(_SPLIT))
        rows = stage(_grouped(halves).mapInArrow(_settle(w), _schema(_OPEN)), "split-contexts")
        spans.append(rows.filter("key is null"))
        open_rows, with_body = rows.filter("key is not null"), True
    shards = _with_bodies(ready[0].select(*_OPEN), docs, w)
    for more in ready[1:]:
        shards = shards.unionByName(more.select(*_OPEN))
    fields = ["key", "doc", "copy", "start", "stop", "body"]
    shards = shards.select(*fields).repartition(F.col("key")).sortWithinPartitions("key", "doc", "copy", "start")
    out = shards.mapInArrow(_sharded(w, method), _schema(_SPAN))
    for more in spans:
        out = out.unionByName(more.select("doc", "copy", "start", "stop"))
    ranges = F.sort_array(F.collect_set(F.struct("start", "stop")))
    return out.groupBy(F.col("doc").alias("_doc"), F.col("copy").alias("_copy")).agg(ranges.alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents with their ranges, null where there are none."""
    return docs.join(spans, ["_doc", "_copy"], "left")


def removed_mask(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n units the ranges cover."""
    edge = np.zeros(n + 1, np.int32)
    if spans:
        np.add.at(edge, [s["start"] for s in spans], 1)
        np.add.at(edge, [s["stop"] for s in spans], -1)
    return np.cumsum(edge[:-1]) > 0


