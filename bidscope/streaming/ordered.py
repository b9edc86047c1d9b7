"""Streams of observations put in order of time per key, with keyed state in the state store.

Rows of a key are held until the watermark has passed them and then leave in order, each beside the values of
the row before it. What cannot be placed this way (rows behind the watermark, and rows still held when the
stream stops) is found by a job over the source, which also mends the rows that follow such a row.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bidscope.operators.skew import previous_values

HELD_ROWS = 100_000  # rows of one key that its state holds; beyond it the oldest half leaves early
GROUPS = 1024  # states that the keys are dealt over: a call of the engine and a value of the store are for many keys
OUT_ROWS = 100_000  # rows that leave at a time


def _placer(names: list[str], fields: int, held_rows: int):
    """Function of (group, rows, state) that holds the rows of a group's keys and lets them go in order.

    Rows are tuples (microseconds, tie, *fields). The state is each key's last row that left, and its held ones.
    """
    read = names[: 3 + fields]

    def leave(key: object, rows: list[tuple], last: tuple | None) -> Iterator[tuple]:
        for row in rows:
            yield (key, *row, last is not None, *(last[2:] if last is not None else (None,) * fields))
            last = row

    def place(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = pickle.loads(state.get[0]) if state.exists else ({}, {})
        out: list[tuple] = []

        def let_go(key: object, n: int) -> None:
            rows = held[key]
            out.extend(leave(key, rows[:n], last.get(key)))
            last[key] = rows[n - 1]
            held[key] = rows[n:]

        if not state.hasTimedOut:
            for part in parts:
                rows = part[read].astype(object)
                touched = set()
                for key, *row in zip(*[c.tolist() for _, c in rows.where(rows.notna(), None).items()]):
                    old = last.get(key)
                    if row[0] is not None and (old is None or (row[0], row[1]) > old[:2]):
                        held.setdefault(key, []).append(tuple(row))
                        touched.add(key)
                for key in touched:
                    if len(held[key]) > held_rows:
                        held[key].sort(key=_place)
                        let_go(key, len(held[key]) // 2)
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=names, dtype=object)
                    out.clear()
        mark = state.getCurrentWatermarkMs()
        for key, rows in held.items():
            rows.sort(key=_place)
            if n := bisect.bisect_right(rows, mark * 1000, key=lambda row: row[0]):
                let_go(key, n)
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)
        held = {key: rows for key, rows in held.items() if rows}
        state.update((pickle.dumps((last, held), pickle.HIGHEST_PROTOCOL),))
        if held:
            state.setTimeoutTimestamp(max(min(rows[0][0] for rows in held.values()) // 1000, mark + 1))

    return place


_place = itemgetter(0, 1)


def placed_rows(
    stream: DataFrame, key: str, time: str, tie: str, fields: list[str], lateness: str = "2 days", held_rows: int = HELD_ROWS,
    groups: int = GROUPS,
) -> DataFrame:
    """``key, time, tie, fields, has_previous, previous_<field>`` of a stream, in the columns of ``previous_values``.

    A row is placed once the newest row seen is ``lateness`` ahead of it. ``tie`` tells rows of equal time apart and
    is not null. A key's state holds its rows of that stretch; when they are more than ``held_rows``, the oldest half
    leaves early. Rows without a time, and rows older than the last placed one of their key, are not placed here.
    Keys are dealt over ``groups`` states, the null key apart; the number stays the same as long as a checkpoint is used.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    timed = stream.select(key, F.col(time).cast("timestamp").alias("_time"), tie, *fields).withWatermark("_time", lateness)
    rows = timed.select(F.col(key).alias("_key"), "_time", F.unix_micros("_time").alias("_micros"), F.col(tie).alias("_tie"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)])
    values = [f"_f{i}" for i in range(len(fields))]
    names = ["_key", "_micros", "_tie", *values, "has_previous", *[f"_p{i}" for i in range(len(fields))]]
    types = [kinds[key].simpleString(), "bigint", kinds[tie].simpleString(), *[kinds[f].simpleString() for f in fields], "boolean", *[kinds[f].simpleString() for f in fields]]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types))
    # nulls beside whole numbers would turn them into floating-point ones in pandas
    group = F.when(F.col("_key").isNull(), -1).otherwise(F.pmod(F.xxhash64("_key"), F.lit(groups))).cast("int")
    placed = rows.withColumn("_group", group).groupBy("_group").applyInPandasWithState(
        _placer(names, len(fields), held_rows), schema, "kept binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return placed.select(
        F.col("_key").alias(key), F.timestamp_micros("_micros").cast(kinds[time]).alias(time), F.col("_tie").alias(tie),
        *[F.col(f"_f{i}").alias(f) for i, f in enumerate(fields)], "has_previous",
        *[F.col(f"_p{i}").alias(f"previous_{f}") for i, f in enumerate(fields)],
    )


def place_into(
    stream: DataFrame, key: str, time: str, tie: str, fields: list[str], folder: str, lateness: str = "2 days", held_rows: int = HELD_ROWS,
    groups: int = GROUPS,
) -> StreamingQuery:
    """Appends placed rows to ``folder/placed`` until everything available is read; nothing is written twice."""
    rows = placed_rows(stream, key, time, tie, fields, lateness, held_rows, groups)
    return (
        rows.writeStream.format("parquet").option("path", f"{folder}/placed").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )


def left_out(source: DataFrame, placed: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Rows of the source that the stream has not placed: late ones, ones without a time, and those still held."""
    name = lambda rows: F.struct(rows[key], rows[time], rows[tie])
    gone = placed.select(key, time, tie)
    return source.join(gone, name(source).eqNullSafe(name(gone)), "left_anti")


def mended_rows(source: DataFrame, placed: DataFrame, key: str, time: str, tie: str, fields: list[str]) -> DataFrame:
    """All rows of the source beside the values before them, as one batch job over it would give.

    Rows placed before a key's first left-out row are right as they are. From there on the key's rows are
    compared again, together with the last right one before them, so the work follows what was left out.
    """
    columns = [key, time, tie, *fields]
    out = left_out(source, placed, key, time, tie).select(*columns)
    since = out.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(time, tie)).alias("_since"))
    found = placed.join(since, placed[key].eqNullSafe(since["_key"]), "left").drop("_key")
    open_ = F.coalesce(F.struct(time, tie) > F.col("_since"), F.lit(False))
    right = found.filter(~open_)
    touched = right.filter(F.col("_since").isNotNull())
    newest = touched.groupBy(key).agg(F.max(F.struct(time, tie, F.struct(*fields).alias("_values"))).alias("_row"))
    newest = newest.select(key, f"_row.{time}", f"_row.{tie}", "_row._values.*")
    again = found.filter(open_).select(*columns).unionByName(out).withColumn("_again", F.lit(True))
    again = again.unionByName(newest.withColumn("_again", F.lit(False)))
    compared = previous_values(again, [key], F.date_trunc("day", F.col(time)), [time, tie], fields)
    return right.drop("_since").unionByName(compared.filter("_again").drop("_again"))
