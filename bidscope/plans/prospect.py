"""Prospecting: which notices matter to which organisation, and how much.

All organisations are matched in one job. Each distinct keyword is searched once per text,
whoever asks for it; organisations come in by an equality join on the keyword. Items that
matched are kept as rows, never nested under their notice, since a notice may have any number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bidscope.functions import fixed_values as fixed
from bidscope.functions.keys import natural_key, relevance_rank
from bidscope.functions.parsing import proposal_closed
from bidscope.functions.scores import notice_score, org_score, score_band, urgency
from bidscope.functions.text import normalize_text
from bidscope.operators.matching import keyword_hits, match_fields
from bidscope.operators.search import in_target_area
from bidscope.operators.skew import evaluate_once, first_per_key
from bidscope.sources.payloads import flatten_notice
from bidscope.session import stage

CONFIG_FIELDS = [
    "states", "max_population", "keywords", "modalities", "high_terms", "medium_terms", "exclusions",
    "microregions", "target_codes", "sources",
]


@dataclass
class Prospects:
    """Opportunities per (organisation, notice) and the items that matched."""

    opportunities: DataFrame
    items: DataFrame


def _terms(configs: DataFrame, column: str) -> DataFrame:
    rows = configs.select("org_id", F.posexplode(F.coalesce(column, F.array())).alias("position", "term"))
    return rows.withColumn("keyword", normalize_text(F.col("term")))


def _org_keywords(configs: DataFrame) -> DataFrame:
    """(org_id, keyword, term, position, is_high, is_medium): a keyword is high if it contains
    one of the organisation's high terms."""
    keywords = _terms(configs, "keywords")
    flags = configs.select(
        "org_id",
        F.transform(F.coalesce("high_terms", F.array()), normalize_text).alias("_high"),
        F.transform(F.coalesce("medium_terms", F.array()), normalize_text).alias("_medium"),
        F.size(F.coalesce("keywords", F.array())).alias("keyword_count"),
    )
    contains_any = lambda terms: F.exists(terms, lambda t: F.contains(F.col("keyword"), t))
    return keywords.join(flags, "org_id").select(
        "org_id", "keyword", "term", "position", "keyword_count",
        contains_any("_high").alias("is_high"), contains_any("_medium").alias("is_medium"),
    )


def _areas(configs: DataFrame) -> DataFrame:
    """(org_id, state, ...) of organisations that look for something."""
    return configs.filter(F.size(F.coalesce("keywords", F.array())) > 0).select(
        "org_id", F.explode(F.array_distinct("states")).alias("state"), "max_population",
        F.coalesce("microregions", F.array()).alias("microregions"),
    )


def in_own_area(pairs: DataFrame, located: DataFrame, areas: DataFrame) -> DataFrame:
    """The (org_id, notice_id) whose notice lies in the organisation's area.

    Takes pairs that a keyword has found, so organisations and notices never meet by state alone.
    """
    inside = (F.col("population") <= F.col("max_population")) & (
        (F.size("microregions") == 0) | F.array_contains("microregions", F.col("microregion_id"))
    )
    return pairs.join(located, "notice_id").join(areas, ["org_id", "state"]).filter(inside).select("org_id", "notice_id")


def notices_with_code(items: DataFrame, targets: DataFrame) -> DataFrame:
    """(org_id, notice_id) of notices with an item whose code starts with a target of the organisation.

    A code gives its prefixes of the lengths that targets have, so that "starts with" becomes an equality join;
    what is no target falls at the join, before notices are made distinct.
    """
    lengths = targets.agg(F.collect_set(F.length("target")).alias("lengths"))
    codes = items.select("notice_id", "code").filter("code IS NOT NULL").crossJoin(F.broadcast(lengths))
    fitting = F.filter("lengths", lambda n: n <= F.length("code"))
    prefixes = codes.select("notice_id", F.explode(F.transform(fitting, lambda n: F.substring("code", F.lit(1), n))).alias("target"))
    return prefixes.join(targets, "target").select("org_id", "notice_id").distinct()


def prospect(
    notices: DataFrame, items: DataFrame, municipalities: DataFrame, configs: DataFrame, as_of: Column, days: int = 7
) -> Prospects:
    """Opportunities of all organisations.

    notices: notice_id, subject, extra_info, state, municipality_id, created_at, closes_at,
    small_business. items: notice_id, item_id, item_no, description, code, quantity, estimate,
    total_estimate. configs: org_id and CONFIG_FIELDS.
    """
    since = as_of - F.make_dt_interval(F.lit(days))
    areas = _areas(configs)
    places = municipalities.select("municipality_id", "population", "microregion_id")
    located = (
        notices.filter(F.col("created_at") >= since).select("notice_id", "state", "municipality_id")
        .join(places, "municipality_id").join(areas.select("state").distinct(), "state", "left_semi")
        .select("notice_id", "state", "population", "microregion_id")
    )
    wanted = located.select("notice_id").distinct()
    texts = notices.join(wanted, "notice_id", "left_semi").select(
        "notice_id", F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("extra_info", F.lit("")).alias("extra_info")
    )
    texts = stage(texts, "prospect-texts")
    fields = F.explode(
        F.array(
            F.struct(F.lit("objeto").alias("field"), F.col("subject").alias("text")),
            F.struct(F.lit("complementar").alias("field"), F.col("extra_info").alias("text")),
        )
    )
    org_keywords = _org_keywords(configs)
    exclusions = _terms(configs, "exclusions")
    written = texts.select("notice_id", fields.alias("f")).select("notice_id", "f.*")
    text_hits = keyword_hits(written, org_keywords, ["notice_id", "field"], "text", is_normal=False)
    own_items = items.join(wanted, "notice_id", "left_semi")
    goods = own_items.select("notice_id", "item_id", "item_no", "description")
    item_hits = keyword_hits(goods, org_keywords, ["notice_id", "item_id", "item_no"], "description", is_normal=False)

    asked = org_keywords.select("org_id", "keyword", "term", "position", "is_high", "is_medium")
    text_found = stage(text_hits.join(asked, "keyword"), "text-hits")
    item_found = stage(item_hits.join(asked, "keyword"), "item-hits")
    pair = ["org_id", "notice_id"]
    pairs = text_found.select(*pair).unionByName(item_found.select(*pair)).distinct()
    whole = texts.select("notice_id", F.concat_ws(" ", "subject", "extra_info").alias("text"))
    barred = keyword_hits(whole, exclusions, ["notice_id"], "text", is_normal=False).join(exclusions.select("org_id", "keyword"), "keyword").select(*pair)
    eligible = stage(in_own_area(pairs, located, areas).join(barred, pair, "left_anti"), "eligible")
    text_found, item_found = (found.join(eligible, pair, "left_semi") for found in (text_found, item_found))

    rank = F.when(F.col("field") == "objeto", 0).when(F.col("field") == "complementar", 1).otherwise(2)
    # a term is listed where it was found first: subject, extra text, then items
    facts = ["org_id", "notice_id", "term", "position", "is_high", "is_medium"]
    found = text_found.select(*facts, "field", F.lit(-1).alias("item_no")).unionByName(
        item_found.select(*facts, F.lit("itens").alias("field"), "item_no")
    )
    per_term = found.groupBy("org_id", "notice_id", "term").agg(
        F.min(rank).alias("first_field"), F.min("item_no").alias("first_item"), F.min("position").alias("position"),
        F.max("is_high").alias("is_high"), F.max("is_medium").alias("is_medium"),
        F.max((F.col("field") == "objeto").cast("int")).alias("in_subject"),
        F.max((F.col("field") == "complementar").cast("int")).alias("in_extra"),
    )
    # one row per keyword of the organisation at most, so these lists are short
    per_notice = per_term.groupBy("org_id", "notice_id").agg(
        F.sum("in_subject").alias("subject_hits"), F.sum("in_extra").alias("extra_hits"),
        F.max("is_high").alias("has_high"), F.max("is_medium").alias("has_medium"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("first_field", "first_item", "position", "term"))), lambda t: t["term"]
        ).alias("terms_found"),
    )
    matched_items = item_found.select("org_id", "notice_id", "item_id").distinct()
    detail = matched_items.join(
        items.select("notice_id", "item_id", "item_no", "description", "quantity", "estimate", "total_estimate"), ["notice_id", "item_id"]
    )
    item_sums = detail.groupBy("org_id", "notice_id").agg(
        F.count(F.lit(1)).alias("relevant_items"),
        F.sum(F.col("total_estimate").cast("decimal(20,6)")).cast("double").alias("relevant_value"),
    )
    totals = own_items.groupBy("notice_id").agg(F.count(F.lit(1)).alias("total_items"))
    targets = configs.select("org_id", F.explode("target_codes").alias("target")).filter("target <> ''")
    with_code = notices_with_code(own_items, targets).withColumn("has_code", F.lit(True))

    base = notices.select("notice_id", "closes_at", F.coalesce("small_business", F.lit(False)).alias("small_business"))
    counts = configs.select("org_id", F.size("keywords").alias("keyword_count"))
    rows = (
        per_notice.join(base, "notice_id").join(counts, "org_id")
        .join(item_sums, ["org_id", "notice_id"], "left")
        .join(with_code, ["org_id", "notice_id"], "left")
        .join(totals, "notice_id", "left")
    )
    rows = rows.withColumns({
        "relevant_items": F.coalesce("relevant_items", F.lit(0)),
        "relevant_value": F.coalesce("relevant_value", F.lit(0.0)),
        "total_items": F.coalesce("total_items", F.lit(0)),
        "has_code": F.coalesce("has_code", F.lit(False)),
    })
    score = org_score(
        F.col("subject_hits"), F.col("keyword_count"), F.col("extra_hits"), F.col("relevant_items"),
        F.col("has_high"), F.col("has_medium"), F.col("has_code"), F.col("small_business"),
    )
    named = F.array_compact(
        F.array(
            F.when(F.col("subject_hits") > 0, "objeto"),
            F.when(F.col("extra_hits") > 0, "complementar"),
            F.when((F.col("relevant_items") > 0) | F.col("has_code"), "itens"),
        )
    )
    rows = rows.withColumn("score", score).withColumns({
        "relevance": score_band(F.col("score")),
        "urgency": urgency(F.col("closes_at"), as_of),
        "fields_matched": named,
    })
    return Prospects(
        rows.select(
            "org_id", "notice_id", "score", "relevance", "urgency", "terms_found", "fields_matched",
            "total_items", "relevant_items", "relevant_value",
        ),
        detail,
    )


# ---------------------------------------------------------------- collection and generic search


def open_in_area(payloads: DataFrame, targets: DataFrame, as_of: Column) -> DataFrame:
    """Payloads still open for proposals in the target municipalities.

    targets: ibge_code, municipality, state.
    """
    ends = F.try_to_timestamp("dataEncerramentoProposta")
    return in_target_area(payloads.filter(~proposal_closed(ends, as_of)), targets)


def collect_notices(payloads: DataFrame, targets: DataFrame, as_of: Column, keep: list[str] | None = None) -> DataFrame:
    """Notice rows of all open payloads in the area, one per natural key (earliest published)."""
    rows = flatten_notice(open_in_area(payloads, targets, as_of), keep)
    rows = rows.withColumn("natural_key", natural_key(F.col("org_tax_id"), F.col("year"), F.col("sequence")))
    return first_per_key(rows, ["natural_key"], [F.col("published_at"), F.col("subject"), F.col("raw")])


def collection_drops(payloads: DataFrame, targets: DataFrame, as_of: Column) -> DataFrame:
    """Per state: payloads seen, closed ones, ones outside the area, and kept ones, in one pass."""
    ends = F.try_to_timestamp("dataEncerramentoProposta")
    from bidscope.sources.payloads import unit_ibge_code

    known = targets.select(F.col("ibge_code").alias("_code")).distinct().withColumn("_known", F.lit(True))
    rows = payloads.withColumn("_closed", proposal_closed(ends, as_of)).withColumn("_code", unit_ibge_code())
    rows = rows.join(known, "_code", "left").withColumn("_inside", F.col("_known").isNotNull())
    return rows.groupBy(F.col("unidadeOrgao.ufSigla").alias("state")).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if("_closed").alias("closed"),
        F.count_if(~F.col("_closed") & ~F.col("_inside")).alias("outside"),
        F.count_if(~F.col("_closed") & F.col("_inside")).alias("kept"),
    )


def generic_search(
    payloads: DataFrame, targets: DataFrame, as_of: Column, keywords: list[str], exclusions: list[str] | None = None,
    high: list[str] | None = None, medium: list[str] | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """Open payloads in the area matching one keyword configuration, scored, best per natural key."""
    keep = keep or []
    rows = match_fields(open_in_area(payloads, targets, as_of), "objetoCompra", "informacaoComplementar", keywords, exclusions or [])
    rows = rows.filter("matched")
    rows = evaluate_once(
        rows,
        _subject=normalize_text(F.coalesce("objetoCompra", F.lit(""))),
        _text=normalize_text(F.concat_ws(" ", F.coalesce("objetoCompra", F.lit("")), F.coalesce("informacaoComplementar", F.lit("")))),
    )
    score = notice_score(
        F.col("_subject"), F.col("_text"), F.col("subject_matches"), F.col("extra_matches"), len(keywords),
        F.col("valorTotalEstimado"), F.col("tipoBeneficioId"),
        high if high is not None else fixed.SEARCH_HIGH_TERMS, medium if medium is not None else fixed.SEARCH_MEDIUM_TERMS,
    )
    rows = rows.withColumn("score", score).withColumns({
        "relevance": score_band(F.col("score")),
        "urgency": urgency(F.try_to_timestamp("dataEncerramentoProposta"), as_of),
    })
    flat = flatten_notice(rows, [*keep, "score", "relevance", "urgency", "terms_found", "fields_matched"])
    flat = flat.withColumn("natural_key", natural_key(F.col("org_tax_id"), F.col("year"), F.col("sequence")))
    return first_per_key(flat, ["natural_key"], [F.col("score").desc(), F.col("published_at"), F.col("raw")])


def prospect_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("score").desc(), F.col("published_at").desc(), F.col("natural_key"))


def changed_configs(old: DataFrame, new: DataFrame) -> DataFrame:
    """New configurations that differ from the old one in a field prospecting uses."""
    before = old.select("org_id", F.struct(*CONFIG_FIELDS).alias("_before"))
    joined = new.join(before, "org_id")
    return joined.filter(~F.struct(*CONFIG_FIELDS).eqNullSafe(F.col("_before"))).drop("_before")


def reprospect_changed(
    stored: DataFrame, old: DataFrame, new: DataFrame, notices: DataFrame, items: DataFrame, municipalities: DataFrame,
    as_of: Column, days: int = 90,
) -> DataFrame:
    """Stored opportunities with those of changed organisations computed anew."""
    changed = changed_configs(old, new)
    fresh = prospect(notices, items, municipalities, changed, as_of, days).opportunities
    untouched = stored.join(changed.select("org_id"), "org_id", "left_anti")
    return untouched.unionByName(fresh)


def best_first(opportunities: DataFrame) -> DataFrame:
    return opportunities.orderBy("org_id", relevance_rank(F.col("relevance")), F.col("score").desc(), "notice_id")
