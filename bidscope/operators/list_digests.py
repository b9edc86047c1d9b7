"""Digests of many narrowed copies of one list of texts, without making the copies.

References that ask the same share one list and differ in the few rows that they leave out. The list's texts lie
joined in one buffer; a reference's digest reads the stretches between the rows it leaves out, so that nothing is
filtered, copied or joined row by row. Every digest still reads the reference's whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bidscope.session import ship_package


class _List:
    """The list of one key: rows are added, then references read it."""

    def __init__(self, key: str):
        self.key = key
        self._rows: list[pa.Table] = []

    def add(self, rows: pa.Table) -> None:
        self._rows.append(rows.select(["id", "value", "text"]))

    def close(self) -> None:
        if not self._rows:
            return
        rows = pa.concat_tables(self._rows).combine_chunks()
        self._rows = []
        self.values = rows["value"].to_numpy()
        self.missing = np.isnan(self.values)
        self.places: dict[object, list[int]] = {}
        for place, own in enumerate(rows["id"].to_pylist()):
            self.places.setdefault(own, []).append(place)
        wide = pa.large_string()
        texts = pc.binary_join_element_wise(pa.scalar("", wide), rows["text"].cast(wide), pa.scalar(" ", wide))
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        _, ends, data = texts.buffers()
        self.ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.texts = memoryview(data if data is not None else b"")

    def digest(self, own: object, low: float, high: float, limit: int | None) -> str:
        """Of the texts with values in the range, as the engine compares them: a NaN is above any number."""
        kept = ((self.values >= low) | self.missing) & ((self.values <= high) | np.isnan(high))
        kept[self.places.get(own, [])] = False
        gone = np.flatnonzero(~kept)
        start, stop = np.concatenate([[0], gone + 1]), np.concatenate([gone, [len(kept)]])
        filled = start < stop
        start, stop = start[filled], stop[filled]
        if limit is not None:
            before = np.cumsum(stop - start) - (stop - start)
            start, stop = start[before < limit], stop[before < limit]
            stop = np.minimum(stop, start + limit - before[: len(start)])
        found = hashlib.md5(usedforsecurity=False)
        ahead = 1  # every text has a space before it, which the first one leaves out
        for a, b in zip(self.ends[start].tolist(), self.ends[stop].tolist()):
            found.update(self.texts[a + ahead : b])
            ahead = 0
        return found.hexdigest()


def list_digests(
    lists: DataFrame, refs: DataFrame, keys: list[str], ref: str, identity: str, order: list[Column], name: str, limit: int | None = None
) -> DataFrame:
    """(``ref``, ``name``): the MD5 of each reference's list as one text, its rows' texts with a space between them.

    lists: ``keys``, ``identity``, value, text (no nulls) and what ``order`` reads. refs: ``keys``, ``ref``, low, high. A
    list has the rows with values from ``low`` to ``high`` but the reference's own, in ``order``; with a limit, the first
    of them. A reference whose key has no rows at all has no digest. The work is that of reading all lists' texts once
    per reference; a task keeps one key's texts and values, and streams the references.
    """
    ship_package(lists.sparkSession)
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("list_key")
    kind = refs.schema[ref].dataType
    places = [f"place_{i}" for i in range(len(order))]
    rows = lists.filter(F.col(identity).isNotNull()).select(
        key, F.lit(False).alias("is_ref"), F.col(identity).cast(kind).alias("id"), F.col("value").cast("double"),
        F.lit(None).cast("double").alias("high"), "text", *[o.alias(p) for o, p in zip(order, places)],
    )
    asking = refs.filter(F.col(ref).isNotNull()).select(
        key, F.lit(True).alias("is_ref"), F.col(ref).alias("id"), F.col("low").cast("double").alias("value"), F.col("high").cast("double"),
        F.lit(None).cast("string").alias("text"), *[F.lit(None).cast(rows.schema[p].dataType).alias(p) for p in places],
    )
    laid = rows.unionByName(asking).repartition("list_key").sortWithinPartitions("list_key", "is_ref", *places).drop(*places)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _List("")
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            codes = table["list_key"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            is_ref = table["is_ref"].to_numpy()
            cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(is_ref.astype(np.int8)) != 0)) + 1
            ids, digests = [], []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = table.slice(a, b - a)
                at = part["list_key"][0].as_py()
                if not is_ref[a]:
                    held = held if held.key == at else _List(at)
                    held.add(part)
                elif held.key == at:
                    held.close()
                    asked = part["id"].to_pylist()
                    ids.append(part["id"])
                    digests += [held.digest(*x, limit) for x in zip(asked, part["value"].to_pylist(), part["high"].to_pylist())]
            if digests:
                found = pa.chunked_array([c for column in ids for c in column.chunks], type=table["id"].type).combine_chunks()
                yield pa.record_batch([found, pa.array(digests, pa.string())], names=[ref, name])

    return laid.mapInArrow(digested, StructType([StructField(ref, kind), StructField(name, StringType())]))
