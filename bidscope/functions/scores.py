"""Scores, ratios and bands as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bidscope.functions import fixed_values as fixed
from bidscope.functions.parsing import floor_days
from bidscope.functions.text import any_term_in


def round_to(value: Column, digits: int = 2) -> Column:
    """Half-up rounding of the decimal value; floating noise past the 8th digit is dropped."""
    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def money_sum(value: Column) -> Column:
    """Sum of amounts as exact decimals, so the result does not depend on the order of tasks."""
    return round_to(F.sum(value.cast("decimal(20,6)")))


def real_discount(estimate: Column, award: Column, limit: float = 80.0) -> Column:
    """Discount in percent, null unless both prices are positive and it lies in 0..limit."""
    percent = (estimate - award) / F.nullif(estimate, F.lit(0.0)) * 100
    valid = (estimate > 0) & (award > 0) & percent.between(0, limit)
    return F.when(valid, round_to(percent))


def select_price(awards: Column, estimate: Column) -> Column:
    """Struct(value, price_source, discount): smallest positive award, else the estimate."""
    best = F.array_min(F.filter(awards, lambda v: v > 0))
    return price_of(best, estimate)


def price_of(best_award: Column, estimate: Column) -> Column:
    """As ``select_price`` when the smallest positive award is already known."""
    estimate = F.coalesce(estimate, F.lit(0.0))
    value = F.coalesce(best_award, F.when(estimate > 0, estimate), F.lit(0.0))
    source = F.when(best_award.isNotNull(), "awarded").otherwise("estimated")
    return F.struct(
        value.alias("value"),
        source.alias("price_source"),
        real_discount(estimate, best_award).alias("discount"),
    )


def predominant_source(awarded: Column, estimated: Column) -> Column:
    return (
        F.when(awarded > estimated, "awarded").when(estimated > awarded, "estimated").otherwise("mixed")
    )


def urgency(closes_at: Column, as_of: Column) -> Column:
    """URGENTE within 3 days (or past), PROXIMA within 7, else NORMAL."""
    days = floor_days(closes_at, as_of)
    return F.when(days <= 3, "URGENTE").when(days <= 7, "PROXIMA").otherwise("NORMAL")


def score_band(score: Column) -> Column:
    return F.when(score >= 65, "ALTA").when(score >= 35, "MEDIA").otherwise("BAIXA")


# ---------------------------------------------------------------- ratios of the reliability score


def _ladder(value: Column, steps: list[tuple[float, float]], beyond: float) -> Column:
    """Piecewise linear fall through (bound, ratio) points, constant before the first."""
    bound, ratio = steps[0]
    chain = F.when(value <= bound, F.lit(ratio))
    for upper, target in steps[1:]:
        chain = chain.when(
            value <= upper, ratio + (target - ratio) * (value - bound) / (upper - bound)
        )
        bound, ratio = upper, target
    return chain.otherwise(F.lit(beyond))


def sample_ratio(total: Column, minimum: int = 3, ideal: int = 10) -> Column:
    return (
        F.when(total <= 0, 0.0)
        .when(total >= ideal, 1.0)
        .when(total >= minimum, 0.5 + 0.5 * (total - minimum) / (ideal - minimum))
        .otherwise(0.5 * total / minimum)
    )


def recency_ratio(days: Column) -> Column:
    return _ladder(days, [(90, 1.0), (180, 0.5), (365, 0.0)], 0.0)


def _dispersion(cv: Column, missing: float) -> Column:
    ladder = _ladder(cv, [(10, 1.0), (25, 0.5), (50, 0.0)], 0.0)
    return F.when(cv.isNull(), F.lit(missing)).otherwise(ladder)


def dispersion_ratio(cv: Column) -> Column:
    return _dispersion(cv, 0.0)


def awarded_ratio(share: Column) -> Column:
    return F.when(share >= 0.8, 0.8 + (share - 0.8)).otherwise(F.greatest(F.lit(0.2), share))


def similarity_ratio(score: Column) -> Column:
    return (
        F.when(score >= 70, 1.0)
        .when(score >= 50, 0.5 + 0.5 * (score - 50) / 20)
        .otherwise(F.greatest(F.lit(0.0), score / 100))
    )


def dispersion_ratio_neutral(cv: Column) -> Column:
    """Second ratio library: an unknown dispersion counts half."""
    return _dispersion(cv, 0.5)


def awarded_ratio_stepped(share: Column) -> Column:
    """Second ratio library: stepped awarded share."""
    return (
        F.when(share >= 1.0, 1.0)
        .when(share >= 0.8, 0.9)
        .when(share >= 0.5, 0.5 + 0.4 * (share - 0.5) / 0.3)
        .when(share > 0, 0.2 + 0.3 * share / 0.5)
        .otherwise(0.2)
    )


def reliability(
    sample: Column, cv: Column, awarded_share: Column, recency_days: Column, similarity: Column
) -> Column:
    """Struct of the five weighted factors, the score 0-100 and its band."""
    factors = {
        "sample": round_to(sample_ratio(sample) * 25, 1),
        "recency": round_to(recency_ratio(recency_days) * 20, 1),
        "awarded": round_to(awarded_ratio(awarded_share) * 20, 1),
        "dispersion": round_to(dispersion_ratio(cv) * 20, 1),
        "similarity": round_to(similarity_ratio(similarity) * 15, 1),
    }
    total = sum(factors.values(), F.lit(0.0))
    score = round_to(total, 1)
    band = (
        F.when(sample < 3, "insuficiente")
        .when(score >= 70, "alta")
        .when(score >= 40, "media")
        .otherwise("baixa")
    )
    return F.struct(
        *[value.alias(name) for name, value in factors.items()],
        score.alias("score"),
        band.alias("band"),
    )


# ---------------------------------------------------------------- notice scores


def notice_score(
    subject: Column,
    text: Column,
    subject_matches: Column,
    extra_matches: Column,
    keyword_count: int,
    estimate: Column,
    benefit_id: Column,
    high: list[str],
    medium: list[str],
) -> Column:
    """Search score 0-100. ``subject`` and ``text`` are normalised; matches are arrays.

    ``subject_matches`` must hold every matched keyword that occurs in the subject.
    """
    share = F.least(F.size(subject_matches) / max(keyword_count, 1) * 3, F.lit(1.0))
    estimate = F.coalesce(estimate, F.lit(0.0))
    points = (
        F.when(F.size(subject_matches) > 0, 30 * share).otherwise(0.0)
        + F.when(F.size(extra_matches) > 0, 15.0).otherwise(0.0)
        + F.when(any_term_in(text, high), 25.0).when(any_term_in(text, medium), 10.0).otherwise(0.0)
        + F.when(estimate.between(5_000.0, 2_000_000.0), 10.0).when(estimate > 0, 5.0).otherwise(0.0)
        + F.when(benefit_id.isin(fixed.SMALL_BUSINESS_BENEFITS), 10.0).otherwise(0.0)
    )
    return round_to(F.least(points, F.lit(100.0)), 1)


def org_score(
    subject_hits: Column,
    keyword_count: Column,
    extra_hits: Column,
    item_hits: Column,
    has_high: Column,
    has_medium: Column,
    has_target_code: Column,
    small_business: Column,
) -> Column:
    """Opportunity score 0-100 from match counts and flags of one (organisation, notice)."""
    share = F.least(subject_hits / F.greatest(keyword_count, F.lit(1)) * 3, F.lit(1.0))
    points = (
        F.when(subject_hits > 0, 25 * share).otherwise(0.0)
        + F.when(extra_hits > 0, 10.0).otherwise(0.0)
        + F.when(item_hits > 0, 20.0).otherwise(0.0)
        + F.when(has_high, 20.0).when(has_medium, 10.0).otherwise(0.0)
        + F.when(has_target_code, 10.0).otherwise(0.0)
    )
    base = round_to(F.least(points, F.lit(100.0)), 1)
    return F.when(small_business, F.least(base + 5, F.lit(100.0))).otherwise(base)


def _recency_points(days: Column) -> Column:
    return (
        F.when(days <= 180, 10.0)
        .when(days <= 365, 10.0 * (1 - (days - 180) / 185))
        .otherwise(0.0)
    )


def _rescale(points: Column) -> Column:
    return round_to(F.least(points * (100 / 65), F.lit(100.0)))


def _flag(test: Column, points: float) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), points).otherwise(0.0)


def _term_points(terms: Column, reference_terms: Column) -> Column:
    total = F.size(reference_terms)
    shared = F.size(F.array_intersect(reference_terms, terms))
    return F.when(total > 0, 20 * F.least(shared / total, F.lit(1.0))).otherwise(0.0)


def notice_points(same_modality: Column, same_state: Column, terms: Column, reference_terms: Column) -> Column:
    """Points of a notice apart from its age."""
    return _flag(same_modality, 20.0) + _flag(same_state, 15.0) + _term_points(terms, reference_terms)


def item_points(good_code: Column, same_state: Column, terms: Column, reference_terms: Column, has_unit: Column) -> Column:
    """Points of an item apart from its age."""
    return (
        _flag(good_code, 12.5) + _flag(same_state, 15.0) + _term_points(terms, reference_terms) + _flag(has_unit, 5.0)
    )


def similarity(points: Column, days: Column) -> Column:
    """Points and age as a similarity of 0 to 100, which never rises with age."""
    return _rescale(points + _recency_points(days))


def notice_similarity(
    same_modality: Column, same_state: Column, terms: Column, reference_terms: Column, days: Column
) -> Column:
    return similarity(notice_points(same_modality, same_state, terms, reference_terms), days)


def item_similarity(
    code: Column, same_state: Column, terms: Column, reference_terms: Column, unit: Column, days: Column
) -> Column:
    points = item_points(F.length(code) >= 4, same_state, terms, reference_terms, unit != "")
    return similarity(points, days)
