import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bidscope.operators.skew import previous_values
from bidscope.streaming import changes, ordered

START = dt.datetime(2024, 1, 1)
SCHEMA = "k int, t timestamp, i int, status string, `_key` int"


def deliver(spark, parts, folder, **options):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        ordered.place_into(stream, "k", "t", "i", ["status"], folder, **options).awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{folder}/in"), spark.read.parquet(f"{folder}/placed")


def sorted_rows(df):
    return sorted(map(tuple, df.select("k", "t", "i", "status", "has_previous", "previous_status").collect()), key=repr)


@pytest.mark.parametrize("held_rows", [100_000, 5])
def test_mended_rows_equal_the_batch(spark, tmp_path, held_rows):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, 2, None]), START + dt.timedelta(hours=rng.randrange(24 * 12)), i, rng.choice(["a", "b", None]), i) for i in range(400)]
    rows += [(1, None, 400, "a", 0), (9, START + dt.timedelta(microseconds=1), 401, None, 0)]
    part = lambda r: 0 if r[1] is None else min((r[1] - START).days // 4 + (r[2] % 9 == 0), 3)
    source, placed = deliver(spark, [[r for r in rows if part(r) == k] for k in range(4)], str(tmp_path), lateness="1 day", held_rows=held_rows)
    want = previous_values(source, ["k"], F.date_trunc("day", F.col("t")), ["t", "i"], ["status"])
    got = ordered.mended_rows(source, placed, "k", "t", "i", ["status"])
    assert sorted_rows(got) == sorted_rows(want) and got.count() == len(rows)
    out = ordered.left_out(source, placed, "k", "t", "i").count()
    assert out + placed.count() == len(rows) and 20 < out < 200  # most rows are placed by the stream itself
    assert placed.select("k", "i").distinct().count() == placed.count()


def test_rows_are_held_until_the_watermark_passes(spark, tmp_path):
    at = lambda hour: START + dt.timedelta(hours=hour)
    parts = [[(1, at(10), 1, "x", 0)], [(1, at(5), 2, "y", 0)], [(2, at(100), 3, "z", 0)]]
    source, placed = deliver(spark, parts, str(tmp_path), lateness="12 hours")
    assert set(sorted_rows(placed)) == {(1, at(5), 2, "y", False, None), (1, at(10), 1, "x", True, "y")}
    alerts = changes.alerts_of(placed, "k", "t", "i", ["status"]).collect()
    assert sorted((r["i"], r["old_value"], r["new_value"]) for r in alerts) == [(1, "y", "x"), (2, None, "y")]
    moved = changes.status_changes(placed, "k", "t", "i", "status").collect()
    assert [(r["i"], r["old_status"], r["new_status"]) for r in moved] == [(1, "y", "x")]
    assert [r["i"] for r in ordered.left_out(source, placed, "k", "t", "i").collect()] == [3]


def test_an_empty_stream_places_nothing(spark, tmp_path):
    source, placed = deliver(spark, [[]], str(tmp_path))
    assert ordered.mended_rows(source, placed, "k", "t", "i", ["status"]).count() == placed.count() == 0


def test_repeated_runs_alert_once(spark, tmp_path):
    day = dt.date(2026, 1, 10)
    rows = [("o1", day + dt.timedelta(3), None, "analisando"), ("o2", day + dt.timedelta(2), dt.datetime(2026, 1, 10, 9), None),
            ("o3", None, None, "analisando"), ("o4", day, None, "ganha")]
    opps = spark.createDataFrame(
        [(o, "u", "n", s or "analisando", d, c) for o, d, c, s in rows],
        "opportunity_id string, user_id string, notice_id string, status string, internal_due date, closes_at timestamp",
    )
    runs = [[day], [day, day + dt.timedelta(1)], [], [day + dt.timedelta(1), day + dt.timedelta(2)]]
    folder = str(tmp_path)
    for run in runs:
        spark.createDataFrame([(d,) for d in run], "day date").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("day date").parquet(f"{folder}/in")
        changes.run_once(changes.deadline_alert_stream(stream, "day", opps), f"{folder}/sent", f"{folder}/checkpoint")
    got = [(r["opportunity_id"], r["kind"], r["days_left"]) for r in spark.read.parquet(f"{folder}/sent").collect()]
    want = [
        (r["opportunity_id"], r["kind"], r["days_left"])
        for k in range(3) for r in changes.deadline_alerts(opps, F.lit(day + dt.timedelta(k))).collect()
    ]
    assert sorted(got) == sorted(want) and len(got) == 5


def test_many_keys_share_a_state(spark, tmp_path):
    big = 2**60 + 1  # stays whole beside null keys and null values
    rows = [(k if k else None, START + dt.timedelta(hours=h), big + k, "a" if h else None) for k in range(200) for h in (0, 50, 90)]
    schema, names = "k bigint, t timestamp, i bigint, status string", ["k", "t", "i", ["status"]]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    run = ordered.place_into(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), *names, str(tmp_path), groups=5)
    run.awaitTermination()
    states = [o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]]
    assert states and max(states) <= 6  # five groups and the null key
    source, placed = spark.read.parquet(f"{tmp_path}/in"), spark.read.parquet(f"{tmp_path}/placed")
    want = previous_values(source, ["k"], F.date_trunc("day", F.col("t")), ["t", "i"], ["status"])
    show = lambda df: sorted(map(tuple, df.select("k", "t", "i", "status", "has_previous", "previous_status").collect()), key=repr)
    assert show(ordered.mended_rows(source, placed, *names)) == show(want) and placed.count() == 200
