"""Dashboards, reports, suppliers, price lookups and operational checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bidscope.functions import fixed_values as fixed
from bidscope.functions.keys import place_label
from bidscope.functions.scores import money_sum, round_to
from bidscope.functions.text import trigram_similarity, trigrams
from bidscope.operators import text_index
from bidscope.operators.joins import not_yet_opportunity
from bidscope.operators.order_stats import HOT_ROWS, price_summary
from bidscope.operators.skew import first_per_key, top_k


def report_export(notices: DataFrame, path: str, file_format: str = "csv") -> None:
    """Write the notice list under its display names."""
    shown = notices.select(*[F.col(c).alias(label) for c, label in fixed.REPORT_COLUMNS.items()])
    shown.write.mode("overwrite").format(file_format).option("header", "true").save(path)


def report_rollup(notices: DataFrame) -> DataFrame:
    """Count and value by relevance, by state, by modality, and in all, in one pass."""
    groups = [["relevance"], ["state"], ["modality"], []]
    columns = [F.col("relevance"), F.col("state"), F.col("modality")]
    rolled = notices.groupingSets(groups, *columns).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("notices"),
        money_sum(F.col("estimate")).alias("total"),
    )
    kind = (
        F.when(F.col("_set") == 3, "relevance").when(F.col("_set") == 5, "state")
        .when(F.col("_set") == 6, "modality").otherwise("total")
    )
    label = (
        F.when(F.col("_set") == 3, F.col("relevance")).when(F.col("_set") == 5, F.col("state"))
        .when(F.col("_set") == 6, F.col("modality")).otherwise("TOTAL")
    )
    return rolled.select(kind.alias("kind"), label.alias("label"), "notices", "total")


def dashboard_counts(notices: DataFrame, state: str | None = None) -> DataFrame:
    """Open notices: total and value, by relevance and by state, over all rows."""
    rows = notices.filter("is_open")
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    rows = rows.select(F.coalesce("relevance", F.lit("BAIXA")).alias("relevance"), F.coalesce("state", F.lit("??")).alias("state"), "estimate")
    rolled = rows.groupingSets([["relevance"], ["state"], []], F.col("relevance"), F.col("state")).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("notices"),
        F.coalesce(money_sum(F.col("estimate")), F.lit(0.0)).alias("total"),
    )
    kind = F.when(F.col("_set") == 1, "relevance").when(F.col("_set") == 2, "state").otherwise("open")
    label = F.when(F.col("_set") == 1, F.col("relevance")).when(F.col("_set") == 2, F.col("state")).otherwise("all")
    return rolled.select(kind.alias("kind"), label.alias("label"), "notices", "total")


def dashboard_summary(
    notices: DataFrame, opportunities: DataFrame, deadlines: DataFrame, watch_alerts: DataFrame,
    user, org, as_of: Column,
) -> dict[str, DataFrame]:
    """The ten tiles of a user's dashboard, each a small table (metric, label, value)."""
    own = opportunities.filter((F.col("user_id") == user) | (F.col("org_id") == org))
    open_rows = notices.filter("is_open")

    def tile(df: DataFrame, metric: str, label: Column, value: Column) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), label.cast("string").alias("label"), value.cast("double").alias("value"))

    def top_counts(df: DataFrame, column: str, metric: str, k: int) -> DataFrame:
        counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return tile(counts.orderBy(F.col("n").desc(), F.col(column)).limit(k), metric, F.col(column), F.col("n"))

    active = own.filter(F.col("status").isin(fixed.OPEN_PIPELINE_STATUSES)).select("notice_id", "proposal_value")
    pipeline_value = active.join(notices.select("notice_id", "estimate"), "notice_id").agg(
        F.coalesce(money_sum(F.coalesce("proposal_value", "estimate")), F.lit(0.0)).alias("v")
    )
    urgent = deadlines.filter((F.col("user_id") == user) & ~F.col("is_read")).orderBy(
        "days_left", "due_date", "notice_id", "kind"
    ).limit(5)
    fresh = not_yet_opportunity(open_rows.filter("relevance = 'ALTA'"), opportunities, user, org).orderBy(
        F.col("published_at").desc(), F.col("notice_id")
    ).limit(5)
    week = F.col("closes_at").between(as_of, as_of + F.expr("interval 7 days"))
    one_pass = notices.agg(
        F.count_if("is_open").alias("open"),
        F.count_if(F.col("is_open") & week).alias("closing"),
        F.max(F.when(F.col("source") == "PNCP", F.unix_timestamp("published_at"))).alias("last"),
    )
    pipeline = own.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    unread = watch_alerts.filter((F.col("user_id") == user) & ~F.col("is_read")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None)
    return {
        "pipeline": tile(pipeline, "pipeline", F.col("status"), F.col("n")),
        "pipeline_value": tile(pipeline_value, "pipeline_value", none, F.col("v")),
        "urgent_deadlines": tile(urgent, "urgent_deadline", F.col("notice_id"), F.col("days_left")),
        "unread_alerts": tile(unread, "unread_alerts", none, F.col("n")),
        "new_high": tile(fresh, "new_high", F.col("notice_id"), F.col("estimate")),
        "by_state": top_counts(open_rows, "state", "by_state", 8),
        "by_modality": top_counts(open_rows.filter(F.coalesce("modality", F.lit("")) != ""), "modality", "by_modality", 5),
        "closing_week": tile(one_pass, "closing_week", none, F.col("closing")),
        "open_total": tile(one_pass, "open_total", none, F.col("open")),
        "last_collection": tile(one_pass, "last_collection", none, F.col("last")),
    }


def union_tiles(tiles: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tiles.values())


# ---------------------------------------------------------------- price lookup, suppliers, platforms


@dataclass
class PriceLookup:
    """Summary, platforms and the cheapest rows of one price lookup."""

    summary: DataFrame
    platforms: DataFrame
    cheapest: DataFrame


def similar_descriptions(items: DataFrame, text: str, threshold: float = 0.3, index: str | None = None) -> DataFrame:
    """Items whose description is similar to a text; each distinct description is compared once.

    ``index`` is the folder of a trigram index of the descriptions; with it only the text's trigrams are read.
    """
    if index is not None:
        alike = text_index.texts_like(items.sparkSession, index, text, threshold)
        return items.join(alike, text_index.text_key(items["description"]) == alike["key"], "left_semi")
    distinct = items.select("description").distinct()
    wanted = trigrams(F.lit(text))
    alike = distinct.filter(trigram_similarity(trigrams(F.col("description")), wanted) >= threshold)
    return items.join(alike, "description", "left_semi")


def price_lookup(
    items: DataFrame, awards: DataFrame, order: list[str], code: str | None = None, text: str | None = None,
    state: str | None = None, since: Column | None = None, hot_rows: int = HOT_ROWS, index: str | None = None,
) -> PriceLookup:
    """Prices of items by exact code, or by similar description when no code is given (through ``index``, if there is one)."""
    rows = items.filter(F.col("estimate") > 0)
    if since is not None:
        rows = rows.filter(F.col("created_at") >= since)
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    rows = rows.filter(F.col("code") == code) if code is not None else similar_descriptions(rows, text or "", index=index)
    flat = rows.join(awards.select("item_id", "award_seq", "unit_award", "discount"), "item_id", "left")
    flat = flat.withColumn("reference", F.coalesce("unit_award", "estimate"))
    one = flat.withColumn("all", F.lit(0))
    stats = price_summary(one, ["all"], "reference", trim_outliers=False, hot_rows=hot_rows)
    discounts = one.groupBy("all").agg(round_to(F.avg("discount")).alias("mean_discount"))
    summary = stats.join(discounts, "all").select("total", "minimum", "maximum", "mean", "median", "mean_discount")
    platforms = flat.filter("platform IS NOT NULL").groupBy("platform").agg(
        round_to(F.avg("reference")).alias("mean_unit"), F.count(F.lit(1)).alias("items")
    )
    cheapest = flat.orderBy("reference", *order).limit(30)
    return PriceLookup(summary, platforms, cheapest)


def top_suppliers(
    awards: DataFrame, items: DataFrame, since: Column, state: str | None = None, limit: int = 20
) -> DataFrame:
    """Suppliers by number of wins, with amounts, discounts and reach."""
    won = awards.filter((F.col("total_award") > 0) & F.col("supplier_id").isNotNull() & (F.col("awarded_at") >= since))
    rows = won.join(items.select("item_id", "state", "municipality"), "item_id")
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    ranked = rows.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("wins"),
        money_sum(F.col("total_award")).alias("total"),
        round_to(F.avg("unit_award")).alias("mean_unit"),
        round_to(F.avg("discount")).alias("mean_discount"),
        F.array_sort(F.collect_set("state")).alias("states"),
        F.countDistinct("municipality").alias("municipalities"),
    )
    return ranked.orderBy(F.col("wins").desc(), F.col("total").desc(), F.col("supplier_id")).limit(limit)


def platform_compare(items: DataFrame, awards: DataFrame, code: str | None = None, state: str | None = None) -> DataFrame:
    """Items, mean price, discount, value and reach of each platform."""
    rows = items.filter((F.col("estimate") > 0) & F.col("platform_id").isNotNull())
    if code is not None:
        rows = rows.filter(F.col("code") == code)
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    flat = rows.join(awards.select("item_id", "unit_award", "total_award", "discount"), "item_id", "left")
    return flat.groupBy("platform", "platform_id").agg(
        F.count(F.lit(1)).alias("items"),
        round_to(F.avg(F.coalesce("unit_award", "estimate"))).alias("mean_unit"),
        round_to(F.avg("discount")).alias("mean_discount"),
        money_sum(F.coalesce("total_award", "total_estimate")).alias("total"),
        F.countDistinct("municipality").alias("municipalities"),
    )


def supplier_profile(awards: DataFrame, items: DataFrame, order: list[str], top_items: int = 50) -> DataFrame:
    """Every supplier's wins, value, platforms, states and dearest items."""
    rows = awards.filter(F.col("supplier_id").isNotNull()).join(
        items.select("item_id", "description", "platform", "state"), "item_id"
    )
    named = lambda c: F.array_sort(F.array_remove(F.collect_set(F.coalesce(c, F.lit(""))), ""))
    totals = rows.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("wins"),
        money_sum(F.col("unit_award")).alias("total_unit"),
        named("platform").alias("platforms"),
        named("state").alias("states"),
    )
    best = top_k(rows, ["supplier_id"], [F.col("unit_award").desc(), *map(F.col, order)], top_items, "_rank")
    nested = best.groupBy("supplier_id").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "item_id", "description", "unit_award"))).alias("items")
    )
    return totals.join(nested, "supplier_id")


def items_by_platform(items: DataFrame, order: list[Column], limit: int = 100, **filters) -> DataFrame:
    """The first ``limit`` matching items, nested under their platform."""
    from bidscope.operators.search import search_items

    chosen = search_items(items, order, limit, **filters)
    platform = F.coalesce(F.nullif("platform", F.lit("")), F.lit("Desconhecida"))
    return chosen.groupBy(platform.alias("platform")).agg(
        F.array_sort(F.collect_list(F.struct("estimate", "description", "notice_id"))).alias("items")
    )


def award_coverage(items: DataFrame, awards: DataFrame) -> DataFrame:
    """Per platform: items, items with a positive award, their share, and awards."""
    positive = awards.filter(F.col("unit_award") > 0).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    rows = items.select("item_id", "platform").join(positive, "item_id", "left")
    return rows.groupBy("platform").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("n").alias("awarded_items"),
        round_to(F.count("n") / F.count(F.lit(1)) * 100, 1).alias("share"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("awards"),
    )


# ---------------------------------------------------------------- configuration


def filter_facets(notices: DataFrame, configs: DataFrame, domains: DataFrame) -> DataFrame:
    """Per organisation: configured states that have notices, keywords, exclusions and code lists.

    configs: org_id, states, keywords, exclusions. domains: org_id, domain, codes.
    """
    present = notices.select(F.col("state").alias("_state")).distinct()
    wanted = configs.select("org_id", F.explode("states").alias("_state"))
    states = wanted.join(present, "_state").groupBy("org_id").agg(F.array_sort(F.collect_set("_state")).alias("states"))
    codes = domains.groupBy("org_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "codes")))).alias("domains")
    )
    base = configs.select("org_id", "keywords", "exclusions")
    joined = base.join(states, "org_id", "left").join(codes, "org_id", "left")
    return joined.withColumn("states", F.coalesce("states", F.array().cast("array<string>")))


def merged_collect_config(configs: DataFrame, domains: DataFrame) -> DataFrame:
    """Union of what all organisations want collected, and the largest population."""
    def all_of(column: str) -> DataFrame:
        """Distinct values first, which tasks do by themselves; only those meet in one place."""
        return configs.select(F.explode(column).alias("value")).distinct().agg(F.array_sort(F.collect_list("value")))

    codes = configs.select(F.explode("modalities").alias("code")).union(
        domains.filter("domain = 'modalidade_contratacao'").select(F.explode("codes"))
    )
    merged = configs.agg(F.max("max_population").alias("max_population")).select(
        all_of("states").scalar().alias("states"), all_of("sources").scalar().alias("sources"), "max_population"
    )
    return merged.withColumn("modalities", codes.distinct().agg(F.array_sort(F.collect_list("code"))).scalar())


def org_prospect_stats(opportunities: DataFrame) -> DataFrame:
    levels = {"high": "ALTA", "medium": "MEDIA", "low": "BAIXA"}
    return opportunities.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("relevance") == level).alias(name) for name, level in levels.items()],
    )


# ---------------------------------------------------------------- operational checks


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows_n")).select(F.lit(name).alias("name"), "rows_n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def notices_by_state(notices: DataFrame) -> DataFrame:
    return notices.groupBy("state").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_open").alias("open"),
        F.count_if("items_collected").alias("with_items"),
    )


def items_by_platform_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("platform").agg(F.count(F.lit(1)).alias("items"))


def microregion_check(microregions: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Microregions per state and municipalities linked to one."""
    linked = municipalities.filter("microregion_id IS NOT NULL").groupBy("state").agg(F.count(F.lit(1)).alias("linked"))
    counts = microregions.groupBy("state").agg(F.count(F.lit(1)).alias("microregions"))
    return counts.join(linked, "state", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))


# ---------------------------------------------------------------- digests and synonyms


def deadline_digest(alerts: DataFrame, notices: DataFrame, keep: int = 10) -> DataFrame:
    """Per user: number of deadline alerts and the nearest ``keep`` as readable lines."""
    shown = alerts.join(notices.select("notice_id", "municipality", "state", "subject"), "notice_id", "left")
    kind = F.when(F.col("kind") == "prazo_interno", "Prazo interno").otherwise("Encerramento")
    when = (
        F.when(F.col("days_left") == 0, "HOJE").when(F.col("days_left") == 1, "AMANHÃ")
        .otherwise(F.format_string("em %d dias", F.col("days_left")))
    )
    line = F.concat_ws(
        " | ", when, place_label(F.col("municipality"), F.col("state")), kind, F.left("subject", F.lit(80))
    )
    counts = alerts.groupBy("user_id").agg(F.count(F.lit(1)).alias("alerts"))
    nearest = top_k(
        shown.withColumn("line", line), ["user_id"], [F.col("days_left"), F.col("notice_id"), F.col("kind")], keep, "_rank"
    )
    lines = nearest.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "line"))), lambda x: x["line"]).alias("lines")
    )
    return counts.join(lines, "user_id")


def high_opportunity_digest(opportunities: DataFrame, notices: DataFrame, keep: int = 10) -> DataFrame:
    """Per organisation: its high-relevance opportunities, the best ``keep`` listed."""
    high = opportunities.filter("relevance = 'ALTA'")
    counts = high.groupBy("org_id").agg(F.count(F.lit(1)).alias("high"))
    best = top_k(high.select("org_id", "notice_id", "score"), ["org_id"],
                 [F.col("score").desc_nulls_last(), F.col("notice_id")], keep, "_rank")
    shown = best.join(notices.select("notice_id", "municipality", "state", "subject"), "notice_id")
    place = place_label(F.col("municipality"), F.col("state"))
    lines = shown.groupBy("org_id").agg(
        F.array_sort(F.collect_list(F.struct("_rank", place.alias("place"), F.left("subject", F.lit(80)).alias("subject"), "score"))).alias("items")
    )
    return counts.join(lines, "org_id")


def synonym_candidates(items: DataFrame, first_words: int = 6, limit: int | None = None) -> DataFrame:
    """Distinct first words of item descriptions, to be reviewed for synonyms: all, or the first in order."""
    text = F.trim("description")
    start = F.lower(F.array_join(F.slice(F.split(text, r"\s+"), 1, first_words), " "))
    rows = items.filter((F.col("estimate") > 0) & (F.length(text) > 5))
    found = rows.select(start.alias("description")).distinct()
    return found if limit is None else found.orderBy("description").limit(limit)


def merge_synonyms(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Existing pairs plus new ones; existing win, blanks and self-maps are dropped."""
    clean = proposed.select(F.lower(F.trim("variant")).alias("variant"), F.lower(F.trim("canonical")).alias("canonical"))
    usable = clean.filter((F.col("variant") != "") & (F.col("canonical") != "") & (F.col("variant") != F.col("canonical")))
    fresh = first_per_key(usable, ["variant"], [F.col("canonical")]).join(existing, "variant", "left_anti")
    return existing.unionByName(fresh)
