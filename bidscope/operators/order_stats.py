"""Exact grouped price statistics: outlier fences, quantiles, trimmed mean.

Order statistics need the rows of a group in value order. Summaries gather an ordinary group's
values in one sorted list, built map-side, so that a key travels once per map task and not once per
row; what is asked per row ranks the group in a window. A group with more than ``hot_rows`` rows would overload one task, so
it is ranked in value bands instead: equal values collapse map-side, each band of a sixteenth
of an octave is ranked on its own, and the row counts of the lower bands are added. Both ways
give the same ranks, and every later step is an aggregate with a map-side part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window, functions as F

from bidscope.functions.scores import round_to
from bidscope.operators.skew import evaluate_once

HOT_ROWS = 500_000  # a list of so many values is 4 MB


def _rows(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())


def _same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    test = F.lit(True)
    for key in keys:
        test = test & left[key].eqNullSafe(right[key])
    return test


def _band(value: Column) -> Column:
    octave = F.floor(F.log2(F.abs(value)) * 16)
    return F.when(value > 0, octave).when(value < 0, -40_000 - octave).otherwise(-20_000)


def _at_rank(rank: Column) -> Column:
    covers = (F.col("_rank") >= rank) & (F.col("_rank") - F.col("_copies") < rank)
    return F.max(F.when(covers, F.col("_v")))


def _lower_rank(n: Column) -> Column:
    return F.floor(n / 4) + 1


def _upper_rank(n: Column) -> Column:
    return F.floor(3 * n / 4) + 1


def _with_fences(df: DataFrame, trim_outliers: bool) -> DataFrame:
    spread = F.col("_q3") - F.col("_q1")
    low, high = F.col("_q1") - 1.5 * spread, F.col("_q3") + 1.5 * spread
    if trim_outliers:
        kept = (F.col("_n") < 4) | F.col("_v").between(low, high)
        under = (F.col("_n") >= 4) & (F.col("_v") < low)
    else:
        kept, under = F.lit(True), F.lit(False)
    return df.withColumns({"_kept": kept, "_under": under})


def _rank_by_window(rows: DataFrame, keys: list[str], trim_outliers: bool) -> DataFrame:
    whole = Window.partitionBy(*keys)
    rank, n = F.col("_rank"), F.col("_n")
    ranked = rows.select(
        *keys,
        "_v",
        F.lit(1).cast("long").alias("_copies"),
        F.row_number().over(whole.orderBy("_v")).cast("long").alias("_rank"),
        F.count(F.lit(1)).over(whole).alias("_n"),
    )
    quartiles = ranked.select(
        "*",
        F.max(F.when(rank == _lower_rank(n), F.col("_v"))).over(whole).alias("_q1"),
        F.max(F.when(rank == _upper_rank(n), F.col("_v"))).over(whole).alias("_q3"),
    )
    return _with_fences(quartiles, trim_outliers).select(
        "*",
        F.sum(F.col("_kept").cast("long")).over(whole).alias("_m"),
        F.sum(F.col("_under").cast("long")).over(whole).alias("_below"),
    )


def _rank_by_bands(rows: DataFrame, keys: list[str], trim_outliers: bool) -> DataFrame:
    # one struct key: never null itself, and null parts compare equal in the joins
    copies = rows.groupBy(F.struct(*keys).alias("_g"), _band(F.col("_v")).alias("_b"), "_v").agg(
        F.count(F.lit(1)).alias("_copies")
    )
    bands = copies.groupBy("_g", "_b").agg(F.sum("_copies").alias("_in_band"))
    # one row per band of a group: a few hundred at most
    upward = Window.partitionBy("_g").orderBy("_b")
    offsets = bands.select(
        "_g",
        "_b",
        (F.sum("_in_band").over(upward) - F.col("_in_band")).alias("_lower"),
        F.sum("_in_band").over(Window.partitionBy("_g")).alias("_n"),
    )
    in_band = Window.partitionBy("_g", "_b").orderBy("_v")
    ranked = (
        copies.withColumn("_rank", F.sum("_copies").over(in_band))
        .join(offsets, ["_g", "_b"])
        .select("_g", "_v", "_copies", (F.col("_rank") + F.col("_lower")).alias("_rank"), "_n")
    )
    quartiles = ranked.groupBy("_g").agg(
        _at_rank(_lower_rank(F.col("_n"))).alias("_q1"),
        _at_rank(_upper_rank(F.col("_n"))).alias("_q3"),
    )
    fenced = _with_fences(ranked.join(quartiles, "_g"), trim_outliers)
    sizes = fenced.groupBy("_g").agg(
        F.sum(F.when(F.col("_kept"), F.col("_copies")).otherwise(0)).alias("_m"),
        F.sum(F.when(F.col("_under"), F.col("_copies")).otherwise(0)).alias("_below"),
    )
    return fenced.join(sizes, "_g").select("*", *[F.col("_g")[k].alias(k) for k in keys])


def _hot(rows: DataFrame, keys: list[str], sizes: DataFrame | None, hot_rows: int) -> DataFrame:
    """Keys of more than ``hot_rows`` rows: at most (all rows / hot_rows), so few enough to send around."""
    if sizes is None:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(sizes.filter(F.col("n") > hot_rows).select(*keys))


def _ranked(df: DataFrame, keys: list[str], value: str, trim_outliers: bool, hot_rows: int | None) -> DataFrame:
    rows = _rows(df, keys, value)
    if hot_rows is None:
        return _rank_by_window(rows, keys, trim_outliers)
    hot = _hot(rows, keys, None, hot_rows)
    test = _same_key(rows, hot, keys)
    columns = [*keys, "_v", "_copies", "_rank", "_n", "_q1", "_q3", "_kept", "_m", "_below"]
    ordinary = _rank_by_window(rows.join(hot, test, "left_anti"), keys, trim_outliers)
    banded = _rank_by_bands(rows.join(hot, test, "left_semi"), keys, trim_outliers)
    return ordinary.select(columns).union(banded.select(columns))


_PICKS = {"p25": 0.25, "p50": 0.50, "p75": 0.75}
_SUMS = ["_n", "_m", "_q1", "_min", "_max", "_s1", "_s2", "_inner_sum", "_inner_n"]
_COLUMNS = [*_SUMS, *[label + end for label in _PICKS for end in ("_low", "_high")]]


def _at(values: Column, index: Column) -> Column:
    return F.get(values, index.cast("int"))


def _grouped(rows: DataFrame, keys: list[str]) -> GroupedData:
    """Groups by the keys with their hash ahead, so that a sort settles most comparisons by a number."""
    return rows.groupBy(F.xxhash64(*keys).alias("_hash"), *keys)


def _lists_by_listed(rows: DataFrame, keys: list[str], listed: str, hot: DataFrame | None) -> DataFrame:
    """A list of values per key, where ``listed`` has the values of the first key that a row counts for.

    Rows that count for the same meet once, whatever the number of their keys; then lists are put together per key.
    Hot keys are taken off the rows first, so a list is never longer than those of its keys.
    """
    name, others = keys[0], keys[1:]
    if hot is not None:
        off = hot.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in others]).agg(F.collect_set(name).alias("_hot"))
        same = F.lit(True)
        for k in others:
            same = same & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
        kept = F.when(F.col("_hot").isNull(), F.col(listed)).otherwise(F.filter(listed, lambda k: ~F.array_contains("_hot", k)))
        rows = rows.join(F.broadcast(off), same, "left").select(*others, "_v", kept.alias(listed))
    cells = _grouped(rows, [listed, *others]).agg(F.collect_list("_v").alias("_part"))
    parts = cells.select(F.explode(listed).alias(name), *others, "_part")
    return _grouped(parts, keys).agg(F.sort_array(F.flatten(F.collect_list("_part"))).alias("_all"))


def _sums_of_lists(lists: DataFrame, keys: list[str], trim_outliers: bool) -> DataFrame:
    n = F.size("_all")
    lists = lists.select("*", n.cast("long").alias("_n"), _at(F.col("_all"), n / 4).alias("_q1"), _at(F.col("_all"), 3 * n / 4).alias("_q3"))
    if trim_outliers:
        spread = F.col("_q3") - F.col("_q1")
        low, high = F.col("_q1") - 1.5 * spread, F.col("_q3") + 1.5 * spread
        inside = F.when(F.col("_n") < 4, F.col("_all")).otherwise(F.filter("_all", lambda v: v.between(low, high)))
    else:
        inside = F.col("_all")
    lists = evaluate_once(lists, _in=inside).drop("_all", "_q3").withColumn("_m", F.size("_in").cast("long")).filter("_m > 0")
    values, m = F.col("_in"), F.col("_m")
    cut = F.greatest(F.lit(1), F.floor(m * 0.1))
    inner_n = F.greatest(F.lit(0), m - 2 * cut)
    off = lambda v: v - F.col("_q1")
    total = lambda of, term: F.aggregate(of, F.lit(0.0), lambda s, v: s + term(v))
    picks = []
    for label, share in _PICKS.items():
        position = (m - 1) * share
        picks += [_at(values, F.floor(position)).alias(label + "_low"), _at(values, F.ceil(position)).alias(label + "_high")]
    return lists.select(
        *keys, "_n", "_m", "_q1", _at(values, F.lit(0)).alias("_min"), _at(values, m - 1).alias("_max"),
        total(values, off).alias("_s1"), total(values, lambda v: off(v) * off(v)).alias("_s2"),
        total(F.slice(values, (cut + 1).cast("int"), inner_n.cast("int")), lambda v: v).alias("_inner_sum"), inner_n.alias("_inner_n"),
        *picks,
    )


def _sums_of_bands(rows: DataFrame, keys: list[str], trim_outliers: bool) -> DataFrame:
    kept = (
        _rank_by_bands(rows, keys, trim_outliers)
        .filter("_kept")
        .withColumn("_rank", F.col("_rank") - F.col("_below"))
        .withColumn("_off", F.col("_v") - F.col("_q1"))
    )
    m, copies = F.col("_m"), F.col("_copies")
    cut = F.greatest(F.lit(1), F.floor(m * 0.1))
    inner = F.greatest(
        F.lit(0),
        F.least(F.col("_rank"), m - cut) - F.greatest(F.col("_rank") - copies, cut),
    )
    picks = []
    for label, share in _PICKS.items():
        position = (m - 1) * share
        picks.append(_at_rank(F.floor(position) + 1).alias(label + "_low"))
        picks.append(_at_rank(F.ceil(position) + 1).alias(label + "_high"))
    return kept.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        F.max("_m").alias("_m"),
        F.max("_q1").alias("_q1"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.sum(copies * F.col("_off")).alias("_s1"),
        F.sum(copies * F.col("_off") * F.col("_off")).alias("_s2"),
        F.sum(F.col("_v") * inner).alias("_inner_sum"),
        F.sum(inner).alias("_inner_n"),
        *picks,
    )


def price_summary(
    df: DataFrame,
    keys: list[str],
    value: str,
    trim_outliers: bool = True,
    sizes: DataFrame | None = None,
    hot_rows: int | None = HOT_ROWS,
    listed: str | None = None,
) -> DataFrame:
    """Statistics of ``value`` per key, after the index-quantile outlier filter.

    Result: keys, total_raw, total, minimum, maximum, mean, median, trimmed_mean, stdev, cv,
    p25, p50, p75; amounts rounded to 2. Groups without values have no row. ``sizes``
    (keys, n) saves the counting pass where the caller already has the counts;
    ``hot_rows=None`` states that every group is small by construction. ``listed`` names a column
    with the list of values of the first key that a row counts for, in place of that key's column.
    """
    rows = _rows(df, keys if listed is None else [listed, *keys[1:]], value)
    each = rows if listed is None else rows.select(F.explode(listed).alias(keys[0]), *keys[1:], "_v")
    hot = None if hot_rows is None else _hot(each, keys, sizes, hot_rows)
    if listed is not None:
        lists = _lists_by_listed(rows, keys, listed, hot)
    else:
        ordinary = rows if hot is None else rows.join(hot, _same_key(rows, hot, keys), "left_anti")
        lists = _grouped(ordinary, keys).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    stats = _sums_of_lists(lists, keys, trim_outliers).select(*keys, *_COLUMNS)
    if hot is not None:
        banded = _sums_of_bands(each.join(hot, _same_key(each, hot, keys), "left_semi"), keys, trim_outliers)
        stats = stats.union(banded.select(*keys, *_COLUMNS))
    m = F.col("_m")
    mean = F.col("_q1") + F.col("_s1") / m
    variance = F.greatest(
        F.lit(0.0), (F.col("_s2") - F.col("_s1") * F.col("_s1") / m) / F.nullif(m - 1, F.lit(0))
    )
    stdev = F.when(m >= 2, F.sqrt(variance))
    trimmed = F.when((m < 4) | (F.col("_inner_n") <= 0), mean).otherwise(
        F.col("_inner_sum") / F.nullif(F.col("_inner_n"), F.lit(0))
    )

    def quantile(label: str, share: float) -> Column:
        position = (m - 1) * share
        part = position - F.floor(position)
        return F.col(label + "_low") * (1 - part) + F.col(label + "_high") * part

    return stats.select(
        *keys,
        F.col("_n").alias("total_raw"),
        m.alias("total"),
        round_to(F.col("_min")).alias("minimum"),
        round_to(F.col("_max")).alias("maximum"),
        round_to(mean).alias("mean"),
        round_to(quantile("p50", 0.50)).alias("median"),
        round_to(trimmed).alias("trimmed_mean"),
        round_to(stdev).alias("stdev"),
        F.when(mean != 0, round_to(stdev / F.nullif(mean, F.lit(0.0)) * 100)).alias("cv"),
        round_to(quantile("p25", 0.25)).alias("p25"),
        round_to(quantile("p50", 0.50)).alias("p50"),
        round_to(quantile("p75", 0.75)).alias("p75"),
    )


def fences(df: DataFrame, keys: list[str], value: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Per key: n, the index quartiles q1 and q3, and the outlier fences low and high."""
    quartiles = (
        _ranked(df, keys, value, True, hot_rows)
        .groupBy(*keys)
        .agg(F.max("_n").alias("n"), F.max("_q1").alias("q1"), F.max("_q3").alias("q3"))
    )
    spread = F.col("q3") - F.col("q1")
    return quartiles.withColumns({
        "low": F.col("q1") - 1.5 * spread,
        "high": F.col("q3") + 1.5 * spread,
    })


def iqr_filter(df: DataFrame, keys: list[str], value: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Rows within 1.5 quartile ranges of the index quartiles; groups under 4 rows stay whole.

    A row without a value is no outlier and stays, whatever its group's size.
    """
    limits = fences(df, keys, value, hot_rows).select(F.struct(*keys).alias("_g"), "n", "low", "high")
    keep = F.col(value).isNull() | (F.col("n") < 4) | F.col(value).between(F.col("low"), F.col("high"))
    return df.withColumn("_g", F.struct(*keys)).join(limits, "_g", "left").filter(keep).select(*df.columns)


def upper_median(df: DataFrame, keys: list[str], value: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Per key: n and the value at index floor(n/2) of the sorted values."""
    middle = _at_rank(F.floor(F.col("_n") / 2) + 1)
    return (
        _ranked(df, keys, value, False, hot_rows)
        .groupBy(*keys)
        .agg(F.max("_n").alias("n"), middle.alias("upper_median"))
    )


def scale_window(
    df: DataFrame, keys: list[str], value: str, factor: float = 20.0, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Keep values within [median/factor, median*factor], the upper median of the key being the
    reference; keys with fewer than two values stay whole."""
    reference = upper_median(df, keys, value, hot_rows).select(
        F.struct(*keys).alias("_g"), "n", "upper_median"
    )
    ref = F.col("upper_median")
    keep = (F.col("n") < 2) | (ref <= 0) | F.col(value).between(ref / factor, ref * factor)
    return df.withColumn("_g", F.struct(*keys)).join(reference, "_g").filter(keep).select(*df.columns)
