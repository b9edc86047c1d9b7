"""Comparison sessions: a user's own selection of notices and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bidscope.functions.keys import place_label, relevance_rank
from bidscope.functions.scores import money_sum, round_to
from bidscope.operators.groups import rank_in_group, redundant_groups
from bidscope.operators.joins import notice_items
from bidscope.operators.order_stats import price_summary
from bidscope.plans import market
from bidscope.session import stage


VIEWED = [
    "item_id", "notice_id", "excluded", "platform", "description", "code", "unit", "estimate", "state", "municipality", "subject", "relevance",
]
COUNTED = ["notice_id", "excluded", "platform", "description", "code", "unit", "estimate"]


def session_items(
    notices: DataFrame, items: DataFrame, session_notices: DataFrame, excluded_items: DataFrame
) -> DataFrame:
    """Items of the selected notices, with an ``excluded`` mark per item.

    session_notices: notice_id, excluded. excluded_items: item_id.
    """
    chosen = notices.join(session_notices.filter("NOT excluded").select("notice_id"), "notice_id", "left_semi")
    rows = notice_items(chosen, items).filter(F.col("estimate") > 0)
    marks = excluded_items.select("item_id").distinct().withColumn("excluded", F.lit(True))
    return rows.join(marks, "item_id", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def shared_items(rows: DataFrame, best: DataFrame | None = None, described: bool = True) -> DataFrame:
    """The session's items with what the item and the notice view read, staged for both: items meet notices once.

    With ``best`` (``best_awards``) they have best_award and won, so that neither view looks for awards again.
    ``described=False`` leaves out ids and notices' texts, for callers that read figures only: a staged column is
    written whether it is read or not.
    """
    shown = VIEWED if described else COUNTED
    if best is not None:
        rows = rows.join(best.select("item_id", "best_award", "won"), "item_id", "left")
        shown = [*shown, "best_award", "won"]
    return stage(rows.select(*shown), "session-rows")


def in_reading_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(relevance_rank(F.col("relevance")), "subject", "item_no", "item_id")


def session_item_view(rows: DataFrame) -> DataFrame:
    """Comparable groups of the session's items: one row per group and platform, cheapest first.

    rows: selected items with best_award (smallest positive award or null). The observed items
    feed several aggregations and are staged.
    """
    named = rows.withColumns({
        "platform": F.coalesce(F.nullif("platform", F.lit("")), F.lit("desconhecida")),
        "state": F.lit(None).cast("string"),  # groups are over all states
    })
    observed = market.observe_items(named).select("platform", "description", "code", "keys", "value", "price_source", "discount")
    keyed = market.key_items(stage(observed, "session-items"), per_state=False)
    base = stage(market.platform_base(keyed), "session-base")
    groups = market.group_table(base)
    redundant = redundant_groups(groups, ["level"], "key", "platform_set")
    groups = groups.join(redundant, market.GROUP, "left_anti").filter("n_platforms >= 2")
    sizes = base.select(*market.GROUP, "platform", "n")
    stats = price_summary(keyed, [*market.GROUP, "platform"], "value", sizes=sizes, listed="levels")
    described = groups.select(*market.GROUP, "description", "unit", "total_observations")
    return rank_in_group(stats.join(described, market.GROUP), market.GROUP, "mean", "platform").select(
        "key", "description", "unit", "total_observations", "platform", "rank", "mean", "median", "total", "cv",
        F.col("saving_vs_dearest").alias("saving"),
    )


def session_notice_view(rows: DataFrame, awards: DataFrame | None = None) -> DataFrame:
    """Per notice: items, sums of unit estimates and unit awards, and the saving in percent.

    The sums add unit prices, not line totals. Without ``awards`` the rows have the sum ``won`` of their item's. Rows without
    the notices' texts give a view without subject, place and relevance.
    """
    joined = rows
    if awards is not None:
        won = awards.filter(F.col("unit_award") > 0).groupBy("item_id").agg(F.sum("unit_award").alias("won"))
        joined = rows.join(won, "item_id", "left")
    estimates = money_sum(F.when(F.col("estimate") > 0, F.col("estimate")))
    texts = [
        F.min("subject").alias("subject"),
        F.min(place_label(F.col("municipality"), F.col("state"))).alias("place"),
        F.min("relevance").alias("relevance"),
    ] if "subject" in rows.columns else []
    totals = joined.groupBy("notice_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(estimates, F.lit(0.0)).alias("sum_unit_estimates"),
        F.coalesce(money_sum(F.col("won")), F.lit(0.0)).alias("sum_unit_awards"),
        *texts,
    )
    both = (F.col("sum_unit_estimates") > 0) & (F.col("sum_unit_awards") > 0)
    saving = F.when(
        both, round_to((1 - F.col("sum_unit_awards") / F.nullif("sum_unit_estimates", F.lit(0.0))) * 100, 1)
    )
    return totals.withColumn("saving", saving)


def session_counts(notices: DataFrame, session_notices: DataFrame) -> DataFrame:
    excluded = session_notices.agg(F.count_if("excluded")).scalar()
    totals = notices.agg(F.count(F.lit(1)).alias("total")).withColumn("excluded", excluded)
    return totals.withColumn("selected", F.col("total") - F.col("excluded"))


def item_insights(view: DataFrame, limit: int | None = None) -> DataFrame:
    """Best platform and price gap of each group, as text; with a limit, of the most observed groups."""
    per_group = view.groupBy("key", "description").agg(
        F.min_by("platform", "rank").alias("best_platform"),
        F.min_by("mean", "rank").alias("best_price"),
        F.max_by("mean", "rank").alias("dearest"),
        F.count(F.lit(1)).alias("platforms"),
        F.max("total_observations").alias("total_observations"),
    )
    gap = (F.col("dearest") - F.col("best_price")) / F.greatest(F.col("best_price"), F.lit(1.0)) * 100
    advice = (
        F.when(F.col("platforms") < 2, "Referência única.")
        .when(gap > 10, F.concat(F.lit("Diferença de "), F.round(gap, 0).cast("long").cast("string"), F.lit("% entre plataformas.")))
        .otherwise("Preços convergentes.")
    )
    rows = per_group.withColumn("advice", advice)
    return rows if limit is None else rows.orderBy(F.col("total_observations").desc(), "key").limit(limit)


def notice_insights(view: DataFrame) -> DataFrame:
    """Saving of each notice as text, with chance and risk notes."""
    saving = F.col("saving")
    shown = F.format_string("%.1f", saving)
    return view.select(
        "notice_id",
        F.left("subject", F.lit(100)).alias("subject"),
        F.when(saving > 0, F.concat(F.lit("Economia de "), shown, F.lit("%."))).otherwise("Sem dados de homologação.").alias("analysis"),
        F.when(saving > 15, "Boa margem para proposta competitiva.").alias("chance"),
        F.when(saving < 0, "Valor homologado acima do estimado.").alias("risk"),
    )


def session_summary(item_view: DataFrame, notice_view: DataFrame) -> DataFrame:
    """One row: notices, groups, groups on several platforms, mean positive saving."""
    groups = item_view.select("key", "platform").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counted = groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") >= 2).alias("multi_platform"))
    saved = notice_view.agg(
        F.count(F.lit(1)).alias("notices"),
        round_to(F.avg(F.when(F.col("saving") > 0, F.col("saving"))), 1).alias("mean_saving"),
    )
    return saved.withColumns({
        "groups": counted.select("groups").scalar(),
        "multi_platform": counted.select("multi_platform").scalar(),
    })


