"""Parsing of dates, amounts, addresses and free-text notice fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from bidscope.functions import fixed_values as fixed
from bidscope.functions.literals import pair_array


def parse_timestamp(text: Column) -> Column:
    """Timestamp of an ISO text; null when missing or not parseable."""
    return F.try_to_timestamp(text)


def proposal_closed(closes_at: Column, as_of: Column) -> Column:
    """Closed only if the end is known and before ``as_of``."""
    return F.coalesce(closes_at < as_of, F.lit(False))


def is_open(closes_at: Column, as_of: Column) -> Column:
    return closes_at.isNull() | (closes_at > as_of)


def notice_url(tax_id: Column, year: Column, sequence: Column) -> Column:
    """Public address of a notice; empty unless all three parts are present."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (tax_id, year, sequence)]
    complete = (parts[0] != "") & ~parts[1].isin("", "0") & ~parts[2].isin("", "0")
    return F.when(complete, F.concat_ws("/", F.lit(fixed.NOTICE_URL_BASE), *parts)).otherwise("")


def parse_notice_url(url: Column) -> Column:
    """Struct(tax_id, year, sequence) of a notice address, or null."""
    pattern = F.lit(fixed.NOTICE_URL_PATTERN)
    group = lambda i: F.regexp_extract(url, fixed.NOTICE_URL_PATTERN, i)
    return F.when(
        F.rlike(url, pattern),
        F.struct(
            group(1).alias("tax_id"),
            group(2).cast("int").alias("year"),
            group(3).cast("int").alias("sequence"),
        ),
    )


def detect_modality(text: Column) -> Column:
    """Procurement form named in a text: the first listed phrase that occurs in it."""
    lowered = F.lower(text)
    hits = F.filter(pair_array(fixed.PORTAL_MODALITIES), lambda p: F.contains(lowered, p["a"]))
    return F.coalesce(F.get(hits, F.lit(0))["b"], F.lit(""))


def parse_br_date(text: Column) -> Column:
    """First dd/mm/yy or dd/mm/yyyy of a text as yyyy-mm-dd; '' when absent or impossible."""
    group = lambda i: F.regexp_extract(text, fixed.BR_DATE_PATTERN, i)
    year = group(3)
    full = (
        F.when(F.length(year) == 4, year)
        .when((F.length(year) == 2) & (year < "50"), F.concat(F.lit("20"), year))
        .when(F.length(year) == 2, F.concat(F.lit("19"), year))
        .otherwise(year)
    )
    iso = F.concat_ws("-", full, group(2), group(1))
    valid = F.rlike(iso, F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.try_to_date(iso, "yyyy-MM-dd").isNotNull()
    return F.when(valid, iso).otherwise("")


def parse_br_money(text: Column) -> Column:
    """'R$ 1.234,56' as 1234.56; 0 when not a number."""
    digits = F.trim(F.replace(text, F.lit("R$"), F.lit("")))
    plain = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def process_number(text: Column) -> Column:
    return F.regexp_extract(text, "(?iU)" + fixed.PROCESS_NUMBER_PATTERN, 1)


def _fpm_steps() -> Column:
    rows = ", ".join(
        f"named_struct('population', {p}, 'coefficient', {c}D)" for p, c in fixed.FPM_STEPS
    )
    return F.expr(f"array({rows})")


def fpm_coefficient(population: Column) -> Column:
    steps = F.filter(_fpm_steps(), lambda s: population <= s["population"])
    return F.coalesce(F.get(steps, F.lit(0))["coefficient"], F.lit(fixed.FPM_ABOVE))


def population_limit(coefficient: Column) -> Column:
    steps = F.filter(_fpm_steps(), lambda s: coefficient <= s["coefficient"])
    return F.coalesce(F.get(steps, F.lit(0))["population"], F.lit(fixed.POPULATION_UNKNOWN))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded toward minus infinity."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)


def date_windows(start: Column, end: Column, days: int = 1) -> Column:
    """Consecutive windows of ``days`` days covering [start, end], as structs(first, last)."""
    firsts = F.sequence(start, end, F.expr(f"interval {int(days)} day"))
    return F.transform(
        firsts,
        lambda d: F.struct(
            d.alias("first"), F.least(F.date_add(d, days - 1), end).alias("last")
        ),
    )


def resolve_period(
    as_of: dt.date,
    days_back: int = 7,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> tuple[dt.date, dt.date]:
    """Explicit period, or the last ``days_back`` days up to ``as_of``."""
    if start and end:
        return start, end
    return as_of - dt.timedelta(days=days_back), as_of
