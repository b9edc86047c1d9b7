"""Notice, item and opportunity searches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, functions as F

from bidscope.functions.keys import relevance_rank
from bidscope.functions.text import normalize_text, text_match, words
from bidscope.operators.text_index import keys_with_terms
from bidscope.sources.payloads import unit_ibge_code


def in_target_area(payloads: DataFrame, targets: DataFrame) -> DataFrame:
    """Payloads of the target municipalities, with the municipality's columns."""
    return payloads.withColumn("ibge_code", unit_ibge_code()).join(targets, "ibge_code")


def prospect_candidates(
    notices: DataFrame, municipalities: DataFrame, states: list[str], since: Column,
    max_population: int, microregions: list[int] | None = None,
) -> DataFrame:
    """Recently created notices of the states in small enough municipalities."""
    places = municipalities.filter(F.col("population") <= max_population)
    if microregions:
        places = places.filter(F.col("microregion_id").isin(microregions))
    recent = notices.filter(F.col("state").isin(states) & (F.col("created_at") >= since))
    return recent.join(places.select("municipality_id", "population", "microregion_id"), "municipality_id")


@dataclass
class OrgFilters:
    """Standing filters of an organisation."""

    modalities: list[int] = field(default_factory=list)
    exclusions: list[str] = field(default_factory=list)
    domains: dict[str, list[int]] = field(default_factory=dict)

    def active_modalities(self) -> list[int]:
        """The organisation's code list, where set, goes before its general setting."""
        return self.domains.get("modalidade_contratacao") or self.modalities


def order_columns(mode: str, tie: str = "notice_id") -> list[Column]:
    """Sort orders of the notice list; ``tie`` makes them total."""
    published = F.col("published_at").desc_nulls_last()
    orders = {
        "published": [published],
        "value": [F.col("estimate").desc_nulls_last()],
        "municipality": [F.col("municipality").asc(), published],
        "score": [F.col("score").desc_nulls_last(), published],
        "relevance": [relevance_rank(F.col("relevance")).asc(), published],
    }
    return [*orders.get(mode, orders["relevance"]), F.col(tie).asc()]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def seek_page(df: DataFrame, order: list[tuple[str, bool]], limit: int, after: Row | None = None) -> DataFrame:
    """The page of rows behind the row ``after`` (the last of the page before; None: the first page).

    ``order`` holds column names and whether they descend, and together tells all rows apart; a null is smaller
    than any value. Every page costs a filter, which reaches the scan, and one page of rows a task, however far
    down it lies. Rows that come in before ``after`` meanwhile don't shift the pages.
    """
    sorts = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for c, down in order:
            beyond, same = beyond | (same & _beyond(c, down, after[c])), same & F.col(c).eqNullSafe(F.lit(after[c]))
        first, down = order[0]
        # The first column's own bound is implied; said apart, it can be pushed into the scan.
        df = df.filter((_beyond(first, down, after[first]) | F.col(first).eqNullSafe(F.lit(after[first]))) & beyond)
    return df.orderBy(*sorts).limit(limit)


def _beyond(column: str, down: bool, value) -> Column:
    """Whether a row's value comes strictly after another in an order with nulls as the smallest."""
    if value is None:
        return F.lit(False) if down else F.col(column).isNotNull()
    if down:
        return (F.col(column) < F.lit(value)) | F.col(column).isNull()
    return F.coalesce(F.col(column) > F.lit(value), F.lit(False))


def guarded_code(df: DataFrame, column: str, wanted: int | None, active: list[int]) -> DataFrame:
    """Apply a code filter only if the code is one the organisation works with."""
    return df.filter(F.col(column) == wanted) if wanted is not None and wanted in active else df


def filter_notices(
    notices: DataFrame,
    org: OrgFilters | None = None,
    states: list[str] | None = None,
    relevance: str | None = None,
    is_open: bool | None = None,
    small_business: bool | None = None,
    subject_like: str | None = None,
    keyword: str | None = None,
    modality_id: int | None = None,
    dispute_mode_id: int | None = None,
    status_id: int | None = None,
    guard_domains: bool = False,
) -> DataFrame:
    """Optional predicates on notices; unset ones do not filter.

    ``guard_domains`` applies a code filter only when the organisation has the code active.
    """
    org = org or OrgFilters()
    rows = notices
    if states:
        rows = rows.filter(F.col("state").isin(states))
    if relevance is not None:
        rows = rows.filter(F.col("relevance") == relevance)
    if is_open is not None:
        rows = rows.filter(F.col("is_open") == is_open)
    if small_business:
        rows = rows.filter("small_business")
    if subject_like:
        rows = rows.filter(F.contains(F.lower("subject"), F.lower(F.lit(subject_like))))
    if keyword:
        rows = rows.filter(F.array_contains("keywords", keyword))
    modalities = org.active_modalities()
    if guard_domains:
        if modality_id is not None:
            rows = guarded_code(rows, "modality_id", modality_id, modalities)
        elif modalities:
            rows = rows.filter(F.col("modality_id").isin(modalities))
        rows = guarded_code(rows, "dispute_mode_id", dispute_mode_id, org.domains.get("modo_disputa", []))
        rows = guarded_code(rows, "status_id", status_id, org.domains.get("situacao_item_contratacao", []))
    else:
        for column, wanted in (
            ("modality_id", modality_id), ("dispute_mode_id", dispute_mode_id), ("status_id", status_id),
        ):
            if wanted is not None and wanted > 0:
                rows = rows.filter(F.col(column) == wanted)
        if modalities:
            rows = rows.filter(F.col("modality_id").isin(modalities))
    for term in org.exclusions:
        rows = rows.filter(~F.contains(F.lower("subject"), F.lower(F.lit(term))))
    return rows


def with_read_flag(notices: DataFrame, reads: DataFrame, user) -> DataFrame:
    """Whether the user has read each notice."""
    marks = reads.filter(F.col("user_id") == user).select("notice_id").distinct().withColumn("_read", F.lit(True))
    return notices.join(marks, "notice_id", "left").withColumn("is_read", F.col("_read").isNotNull()).drop("_read")


def search_notices(
    notices: DataFrame, reads: DataFrame, user, order: str = "relevance", limit: int = 20, offset: int = 0, **filters
) -> tuple[DataFrame, DataFrame]:
    """One page of the filtered notices with read marks, and the total count as a one-row table."""
    rows = filter_notices(notices, **filters)
    shown = page(rows, order_columns(order), limit, offset)
    return with_read_flag(shown, reads, user), rows.agg(F.count(F.lit(1)).alias("total"))


def search_notices_flexible(
    notices: DataFrame, text_terms: list[str] | None = None, state: str | None = None,
    modality: str | None = None, relevance: str | None = None, is_open: bool | None = None,
    small_business: bool | None = None, min_value: float | None = None, max_value: float | None = None,
    keyword: str | None = None, order: str = "relevance", limit: int = 20, index: str | None = None,
) -> DataFrame:
    """Free-form search; every filter, the keyword one included, comes before the limit.

    ``index`` is the folder of a word index of the subjects by notice; with it the subjects are not searched.
    """
    rows = notices
    for column, wanted in (("state", state), ("modality", modality), ("relevance", relevance),
                           ("is_open", is_open), ("small_business", small_business)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    if min_value is not None:
        rows = rows.filter(F.col("estimate") >= min_value)
    if max_value is not None:
        rows = rows.filter(F.col("estimate") <= max_value)
    if text_terms and index is not None:
        found = keys_with_terms(rows.sparkSession, index, text_terms)
        rows = rows.join(found.withColumnRenamed("key", "notice_id"), "notice_id", "left_semi")
    elif text_terms:
        rows = rows.filter(text_match(words(normalize_text(F.col("subject"))), text_terms))
    if keyword:
        rows = rows.filter(F.exists("keywords", lambda k: F.contains(F.lower(k), F.lower(F.lit(keyword)))))
    return page(rows, order_columns(order), limit)


def filter_items(
    items: DataFrame, state: str | None = None, platform_id: int | None = None, code: str | None = None,
    min_value: float | None = None, max_value: float | None = None, text_terms: list[str] | None = None,
) -> DataFrame:
    rows = items
    for column, wanted in (("state", state), ("platform_id", platform_id), ("code", code)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    if min_value is not None:
        rows = rows.filter(F.col("estimate") >= min_value)
    if max_value is not None:
        rows = rows.filter(F.col("estimate") <= max_value)
    if text_terms:
        rows = rows.filter(text_match(words(normalize_text(F.col("description"))), text_terms))
    return rows


def search_items(items: DataFrame, order: list[Column], limit: int = 50, **filters) -> DataFrame:
    return filter_items(items, **filters).orderBy(*order).limit(limit)


def search_org_opportunities(
    opportunities: DataFrame, notices: DataFrame, municipalities: DataFrame, org_id,
    states: list[str] | None = None, relevance: str | None = None, is_open: bool | None = None,
    subject_like: str | None = None, modality_id: int | None = None, microregions: list[int] | None = None,
    order: str = "score", limit: int = 20, offset: int = 0,
) -> DataFrame:
    """The organisation's opportunities with their notice; for an organisation without any,
    the notices themselves with neutral scores."""
    own = opportunities.filter(F.col("org_id") == org_id)
    scored = own.select("notice_id", "score", "relevance", "urgency", F.lit(True).alias("prospected"))
    base = notices.drop("score", "relevance", "urgency")
    found = base.join(scored, "notice_id")
    none_yet = own.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    neutral = base.filter(none_yet).select(
        "*", F.lit(None).cast("double").alias("score"), F.lit("BAIXA").alias("relevance"),
        F.lit(None).cast("string").alias("urgency"), F.lit(False).alias("prospected"),
    )
    places = municipalities.select("municipality_id", "microregion_id")
    rows = found.unionByName(neutral).join(places, "municipality_id", "left")
    if states:
        rows = rows.filter(F.col("state").isin(states))
    if relevance is not None:
        rows = rows.filter((F.col("relevance") == relevance) | ~F.col("prospected"))
    if is_open is not None:
        rows = rows.filter(F.col("is_open") == is_open)
    if subject_like:
        rows = rows.filter(F.contains(F.lower("subject"), F.lower(F.lit(subject_like))))
    if modality_id is not None:
        rows = rows.filter(F.col("modality_id") == modality_id)
    if microregions:
        rows = rows.filter(F.col("microregion_id").isin(microregions))
    return page(rows, order_columns(order), limit, offset)


def notices_since(notices: DataFrame, since: Column) -> DataFrame:
    """Open notices created since a moment, most relevant and newest first."""
    return notices.filter((F.col("created_at") >= since) & F.col("is_open")).orderBy(*order_columns("relevance"))


def open_notices(notices: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Open notices with population and transfer coefficient of their municipality."""
    from bidscope.functions.parsing import fpm_coefficient

    places = municipalities.select(
        "municipality_id", "population", fpm_coefficient(F.col("population")).alias("fpm")
    )
    return notices.filter("is_open").join(places, "municipality_id", "left")


def active_watches(watches: DataFrame) -> DataFrame:
    return watches.filter("active")
