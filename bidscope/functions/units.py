"""Units of measure and pairwise comparability."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bidscope.functions import fixed_values as fixed
from bidscope.functions.literals import text_map
from bidscope.functions.text import normalize_description


def _canonical_map() -> Column:
    entries = [(member, min(group)) for group in fixed.UNIT_GROUPS for member in group]
    return text_map(entries)


def unit_group(unit: Column) -> Column:
    """Representative of the unit's group, or null if the unit is unknown."""
    return F.element_at(_canonical_map(), normalize_description(unit))


def canonical_unit(unit: Column) -> Column:
    return F.coalesce(unit_group(unit), normalize_description(unit))


def units_compatible(left: Column, right: Column) -> Column:
    """A missing unit never blocks; otherwise equal, or known members of one group."""
    blank = (F.coalesce(left, F.lit("")) == "") | (F.coalesce(right, F.lit("")) == "")
    same = normalize_description(left) == normalize_description(right)
    same_group = F.coalesce(unit_group(left) == unit_group(right), F.lit(False))
    return blank | F.coalesce(same, F.lit(False)) | same_group


def categories_compatible(left: Column, right: Column) -> Column:
    forbidden = F.lit(False)
    for a, b in fixed.INCOMPATIBLE_CATEGORIES:
        forbidden = forbidden | ((left == a) & (right == b)) | ((left == b) & (right == a))
    return ~forbidden


def max_scale_ratio(category: Column) -> Column:
    limits = F.create_map(*[F.lit(p) for pair in fixed.MAX_SCALE_RATIO.items() for p in pair])
    return F.coalesce(F.element_at(limits, category), F.lit(fixed.MAX_SCALE_RATIO_DEFAULT))


def scale_compatible(left: Column, right: Column, category: Column) -> Column:
    positive = (left > 0) & (right > 0)
    ratio = F.greatest(left, right) / F.least(left, right)
    return F.when(positive, ratio <= max_scale_ratio(category)).otherwise(False)


def comparable_pair(left: Column, right: Column) -> Column:
    """Struct(comparable, reason, adjust) for two structs of
    (price_source, category, unit, value); the first failed rule names the reason."""
    both_positive = (left["value"] > 0) & (right["value"] > 0)
    out_of_scale = both_positive & ~scale_compatible(
        F.when(both_positive, left["value"]).otherwise(1.0),
        F.when(both_positive, right["value"]).otherwise(1.0),
        left["category"],
    )
    reason = (
        F.when(~left["price_source"].eqNullSafe(right["price_source"]), "fontes_diferentes")
        .when(~categories_compatible(left["category"], right["category"]), "categorias_incompativeis")
        .when(~units_compatible(left["unit"], right["unit"]), "unidades_incompativeis")
        .when(F.coalesce(out_of_scale, F.lit(False)), "escala_incompativel")
    )
    adjust = (
        F.when(reason.isNotNull(), 0.0)
        .when(left["category"].eqNullSafe(right["category"]), 1.0)
        .otherwise(0.8)
    )
    return F.struct(
        reason.isNull().alias("comparable"), reason.alias("reason"), adjust.alias("adjust")
    )
