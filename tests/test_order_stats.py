import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from bidscope.operators.order_stats import HOT_ROWS, fences, iqr_filter, price_summary, scale_window


def expected(values):
    """The statistics by their definition, on a plain list."""
    ordered, n = sorted(values), len(values)
    kept = ordered
    if n >= 4:
        q1, q3 = ordered[n // 4], ordered[3 * n // 4]
        kept = [v for v in ordered if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    m = len(kept)
    cut = max(1, math.floor(m * 0.1))
    inner = kept if m < 4 else kept[cut:m - cut]

    def quantile(p):
        k = (m - 1) * p
        low, high = math.floor(k), math.ceil(k)
        return kept[low] if low == high else kept[low] * (high - k) + kept[high] * (k - low)

    return {
        "total_raw": n, "total": m, "minimum": kept[0], "maximum": kept[-1], "mean": statistics.mean(kept),
        "median": statistics.median(kept), "trimmed_mean": statistics.mean(inner),
        "stdev": statistics.stdev(kept) if m >= 2 else None,
        "p25": quantile(0.25), "p75": quantile(0.75),
    }


def samples():
    rng = random.Random(7)
    groups = {
        "outlier": [10, 12, 11, 13, 14, 100], "low": [0.1, 50, 52, 48, 55, 51], "three": [1, 2, 3],
        "one": [42], "trim": [1, 10, 11, 12, 13, 14, 100], "five": [10, 20, 30, 40, 50],
        "ties": [5.0] * 50 + [6.0] * 3, "signed": [-4, -2, 0, 0, 3, 9, 27],
    }
    for i in range(20):
        groups[f"r{i}"] = [round(rng.lognormvariate(4, 1.5), 2) for _ in range(rng.randint(1, 120))]
    return {k: [float(v) for v in vs] for k, vs in groups.items()}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, v) for k, vs in samples().items() for v in vs] + [("nulls", None)]
    return spark.createDataFrame(data, "grp string, value double")


@pytest.mark.parametrize("hot_rows", [2_000_000, 30, 0, None])
def test_summary_matches_definition_whichever_way_groups_are_ranked(rows, hot_rows):
    got = {r["grp"]: r for r in price_summary(rows, ["grp"], "value", hot_rows=hot_rows).collect()}
    wanted = {k: expected(v) for k, v in samples().items()}
    assert set(got) == set(wanted)
    for name, stats in wanted.items():
        for field, value in stats.items():
            if value is None:
                assert got[name][field] is None
            else:
                assert got[name][field] == pytest.approx(value, abs=0.011), (name, field)


def test_null_keys_form_a_group(spark):
    data = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    for hot_rows in (10, 0):
        got = {r["k"]: r["mean"] for r in price_summary(data, ["k"], "v", hot_rows=hot_rows).collect()}
        assert got == {None: 2.0, "a": 5.0}


def test_iqr_filter_keeps_rows_and_fences(rows):
    kept = iqr_filter(rows.filter("grp = 'outlier'"), ["grp"], "value")
    assert sorted(r["value"] for r in kept.collect()) == [10, 11, 12, 13, 14]
    f = fences(rows.filter("grp = 'five'"), ["grp"], "value").first()
    assert (f["q1"], f["q3"]) == (20.0, 40.0)


def test_scale_window(spark):
    data = spark.createDataFrame([("a", v) for v in (1.0, 100.0, 110.0, 5000.0)] + [("b", 1.0)], "k string, v double")
    got = sorted((r["k"], r["v"]) for r in scale_window(data, ["k"], "v").collect())
    assert got == [("a", 100.0), ("a", 110.0), ("b", 1.0)]


@pytest.mark.parametrize("hot_rows", [None, 0, 4, 30, HOT_ROWS])
def test_rows_that_count_for_several_keys(spark, hot_rows):
    rng = random.Random(11)
    levels = [["*"], ["*", "A"], ["*", "B"], ["*", "*"], ["*", "C"]]
    data = [(rng.choice(levels), rng.choice(["k1", "k2", None]), rng.choice([None, -1.0, 0.0, 5.0, 7.5, 900.0, rng.random() * 9])) for _ in range(160)]
    rows = spark.createDataFrame(data, "levels array<string>, k string, v double")
    each = rows.select(F.explode("levels").alias("level"), "k", "v")
    plain = [tuple(r) for r in price_summary(each, ["level", "k"], "v", hot_rows=0).collect()]
    got = [tuple(r) for r in price_summary(rows, ["level", "k"], "v", hot_rows=hot_rows, listed="levels").collect()]
    order = lambda r: (r[0], r[1] or "")
    assert sorted(got, key=order) == sorted(plain, key=order) and len(got) == 12
