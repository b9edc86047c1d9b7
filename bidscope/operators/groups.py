"""Comparable groups: redundancy, units, comparability, ranking inside a group."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bidscope.functions.keys import key_kind
from bidscope.functions.scores import round_to
from bidscope.functions.units import canonical_unit
from bidscope.session import stage


COVERS = 4_096  # masks that stand in one row
_WORD = 63  # platforms of one mask word


def _masks(sets: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Platform sets as bit masks: one word for every 63 different platforms there are."""
    exploded = sets.select(*keys, "_set", F.explode_outer("_set").alias("_platform"))
    numbered = exploded.filter("_platform IS NOT NULL").select("_platform").distinct()
    # one row per platform there is, so this order is over a small table
    numbered = stage(numbered.withColumn("_number", F.row_number().over(Window.orderBy("_platform")) - 1), "platform-numbers")
    last = numbered.agg(F.max("_number")).first()[0] or 0
    names = [f"_m{w}" for w in range(last // _WORD + 1)]
    bit = F.expr(f"shiftleft(1L, cast(_number % {_WORD} as int))")
    masks = [
        F.coalesce(F.bit_or(F.when(F.expr(f"_number div {_WORD}") == w, bit)), F.lit(0).cast("long")).alias(name) for w, name in enumerate(names)
    ]
    return exploded.join(numbered, "_platform", "left").groupBy(*keys, "_set").agg(*masks), names


def _cover_rows(covers: DataFrame, level: list[str], names: list[str]) -> DataFrame:
    """The covers of a level in rows of ``COVERS``, those of most platforms first."""
    order = Window.partitionBy(*level, "_covered").orderBy(F.col("_n").desc(), *names)
    ranked = covers.withColumn("_rank", F.row_number().over(order))
    return ranked.groupBy(*level, "_covered", F.expr(f"(_rank - 1) div {COVERS}").alias("_row")).agg(
        F.array_sort(F.collect_list(F.struct("_rank", *names))).alias("_covers")
    )


def _semi(left: DataFrame, rows: DataFrame, level: list[str], test: Column, how: str) -> DataFrame:
    """Rows of ``left`` for which a cover of their level passes (or none does)."""
    renamed = rows.select(*[F.col(c).alias(f"_c_{c}") for c in [*level, "_covered"]], "_covers")
    for name in [*level, "_covered"]:
        test = F.col(name).eqNullSafe(F.col(f"_c_{name}")) & test
    return left.join(renamed, test, how)


def redundant_groups(groups: DataFrame, level: list[str], key: str, platforms: str) -> DataFrame:
    """(level, key) of the groups another, more trusted group makes superfluous.

    A term group falls if an exact-code or four-digit-code group on two or more platforms
    covers at least half of its platforms; a four-digit-code group likewise against exact
    ones. Only platform sets matter, so the test runs on the distinct sets, as bit masks. A set
    inside another covers nothing that the other doesn't, so only maximal masks are kept, per level and kind
    that they may cover. Masks stand in rows of ``COVERS``, large ones first; a group reads on only until one
    covers it. No pairs of groups or sets are made. Null platforms do not count; a group without any platform falls
    where there is a cover at all.
    """
    tagged = groups.select(
        *level, key, key_kind(F.col(key)).alias("_kind"), F.array_sort(F.array_compact(F.array_distinct(platforms))).alias("_set")
    )
    sets, names = _masks(tagged.select(*level, "_kind", "_set").distinct(), [*level, "_kind"])
    sets = stage(sets.withColumn("_n", F.size("_set")), "platform-sets")

    kinds = F.when(F.col("_kind") == "ncm", F.array(F.lit("desc"), F.lit("ncm4"))).when(F.col("_kind") == "ncm4", F.array(F.lit("desc")))
    covers = sets.filter("_n >= 2").select(*level, F.explode(kinds).alias("_covered"), "_n", *names).distinct()
    inside = F.exists("_covers", lambda c: _all(F.col(m).bitwiseAND(c[m]) == F.col(m) for m in names) & ~_all(F.col(m) == c[m] for m in names))
    largest = _cover_rows(covers, level, names).filter("_row = 0")
    maximal = stage(_semi(covers, largest, level, inside, "left_anti"), "maximal-sets")

    half = F.ceil(F.col("_n") / 2)
    shared = lambda c: sum((F.bit_count(F.col(m).bitwiseAND(c[m])) for m in names), F.lit(0))
    probes = sets.filter(F.col("_kind").isin("desc", "ncm4")).withColumn("_covered", F.col("_kind"))
    covered = _semi(probes, _cover_rows(maximal, level, names), level, F.exists("_covers", lambda c: shared(c) >= half), "left_semi")
    on = [tagged[c].eqNullSafe(covered[c]) for c in [*level, "_kind", "_set"]]
    return tagged.join(covered, on, "left_semi").select(*level, key)


def _all(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def group_unit(items: DataFrame, keys: list[str], unit: str, order: Column | None = None) -> DataFrame:
    """Most frequent canonical unit of each group and the share of items compatible with it.

    Ties go to the smallest ``order`` seen for the unit, then to the smaller unit.
    """
    order = F.lit(0) if order is None else order
    raw = F.coalesce(F.col(unit), F.lit(""))
    per_unit = items.groupBy(*keys, canonical_unit(raw).alias("_unit"), (raw == "").alias("_blank")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_order")
    )
    # a group has few distinct units, so this step is small
    per_name = per_unit.groupBy(*keys, "_unit").agg(
        F.sum("_n").alias("_n"),
        F.min("_order").alias("_order"),
        F.sum(F.when(F.col("_blank"), F.col("_n")).otherwise(0)).alias("_unnamed"),
    )
    modal = per_name.groupBy(*keys).agg(
        F.min_by("_unit", F.struct(-F.col("_n"), "_order", "_unit")).alias("unit"),
        F.sum("_n").alias("total"),
        F.sum("_unnamed").alias("_unnamed"),
        F.map_from_entries(F.collect_list(F.struct("_unit", "_n"))).alias("_counts"),
        F.max(F.when(F.col("_unnamed") > 0, F.struct("_unit", "_unnamed"))).alias("_blank_unit"),
    )
    named = F.element_at("_counts", F.col("unit"))
    unnamed_in_modal = F.when(
        F.col("_blank_unit._unit") == F.col("unit"), F.col("_blank_unit._unnamed")
    ).otherwise(0)
    compatible = F.when(F.col("unit") == "", F.col("total")).otherwise(
        named + F.col("_unnamed") - F.coalesce(unnamed_in_modal, F.lit(0))
    )
    return modal.select(*keys, "unit", round_to(compatible / F.col("total")).alias("unit_rate"), "total")


def comparability(
    is_code_key: Column,
    unit_rate: Column,
    min_sample: Column,
    mean_cv: Column,
    awarded_share: Column,
    mean_ratio: Column,
) -> Column:
    """Comparability score 0-100 of a group as Struct(score, band)."""
    points = (
        F.when(is_code_key, 20.0).otherwise(0.0)
        + F.when(unit_rate >= 0.8, 20.0).when(unit_rate >= 0.5, 10.0).otherwise(0.0)
        + F.when(min_sample >= 5, 15.0).when(min_sample >= 3, 10.5).when(min_sample >= 1, 4.5).otherwise(0.0)
        + F.when(mean_cv < 15, 15.0).when(mean_cv < 30, 9.0).when(mean_cv < 50, 3.0).otherwise(0.0)
        + F.when(awarded_share >= 0.8, 15.0)
        .when(awarded_share >= 0.5, 10.5)
        .when(awarded_share > 0, 4.5)
        .otherwise(0.0)
        + F.when(mean_ratio <= 5, 15.0).when(mean_ratio <= 10, 9.0).when(mean_ratio <= 50, 3.0).otherwise(0.0)
    )
    score = round_to(F.least(points, F.lit(100.0)))
    band = F.when(score >= 70, "alta").when(score >= 40, "media").otherwise("baixa")
    return F.struct(score.alias("score"), band.alias("band"))


def rank_in_group(df: DataFrame, group: list[str], mean: str, platform: str) -> DataFrame:
    """Rank 1..n by mean (nulls last, ties by platform), difference to the leader and to the dearest.

    A group has one row per platform, so the windows stay tiny.
    """
    whole = Window.partitionBy(*group)
    ordered = whole.orderBy(F.col(mean).asc_nulls_last(), F.col(platform))
    lowest, highest = F.min(mean).over(whole), F.max(mean).over(whole)
    delta = F.when(
        (lowest > 0) & (F.col(mean) != 0),
        F.least((F.col(mean) - lowest) / lowest * 100, F.lit(500.0)),
    )
    saving = F.when(
        (F.count(F.lit(1)).over(whole) >= 2) & (highest > 0),
        round_to((1 - F.col(mean) / highest) * 100, 1),
    )
    return df.withColumns({
        "rank": F.row_number().over(ordered),
        "delta_to_leader": delta,
        "saving_vs_dearest": saving,
    })


def winner_flags(df: DataFrame, score: str, band: str) -> DataFrame:
    """Raw, score-weighted and high-confidence win of the first-ranked platform of each group."""
    first = F.col("rank") == 1
    return df.withColumns({
        "win": first.cast("int"),
        "weighted_win": F.when(first, F.col(score) / 100).otherwise(0.0),
        "high_win": (first & (F.col(band) == "alta")).cast("int"),
    })
