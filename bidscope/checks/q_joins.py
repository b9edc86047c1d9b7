"""Joins, set operations and ranking windows over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.checks.registry import query
from bidscope.checks.star import ITEM_SQL, MUNICIPALITY_SQL, NOTICE_SQL, PLAIN_ITEM_SQL, as_of, items, municipalities, notices, r, table
from bidscope.functions.keys import notice_hash
from bidscope.functions.parsing import notice_url
from bidscope.functions.scores import round_to
from bidscope.operators import joins, skew
from bidscope.operators.tables import latest_per_key

_ITEM_ID = "notice_id || '-' || item_no || '-' || part_id || '-' || supplier_id"


def _item_id():
    return F.concat_ws("-", "notice_id", "item_no", "part_id", "supplier_id").alias("item_id")


def item_rows(spark, sf, with_state=False):
    return items(spark, sf, with_state=with_state).select("*", _item_id())


def award_rows(spark, sf):
    """One award per finished line, a second one where the discount is high."""
    rows = table(spark, sf, "lineitem").filter("l_linestatus = 'F'")
    seqs = F.when(F.col("l_discount") >= 0.08, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item_id"),
        F.explode(seqs).alias("award_seq"), price.alias("base"), F.col("l_suppkey").alias("supplier_id"),
        "l_quantity", F.round(F.col("l_discount") * 100, 2).alias("discount"), F.col("l_shipdate").alias("awarded_at"),
    ).select(
        "item_id", "award_seq", (F.col("base") * F.col("award_seq")).alias("unit_award"),
        (F.col("base") * F.col("award_seq") * F.col("l_quantity")).alias("total_award"), "supplier_id", "discount", "awarded_at",
    )


AWARD_SQL = """award AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS item_id, CAST(s AS INTEGER) AS award_seq,
  l_extendedprice * (1 - l_discount) * s AS unit_award, l_extendedprice * (1 - l_discount) * s * l_quantity AS total_award, l_suppkey AS supplier_id,
  round(l_discount * 100, 2) AS discount, l_shipdate AS awarded_at
  FROM lineitem, (VALUES (1), (2)) v(s) WHERE l_linestatus = 'F' AND (s = 1 OR l_discount >= 0.08))"""
_WITH_ID = f"{PLAIN_ITEM_SQL}, it AS (SELECT *, {_ITEM_ID} AS item_id FROM item), {AWARD_SQL}"


@query(
    "J1_notice_municipality",
    f"WITH {NOTICE_SQL}, {MUNICIPALITY_SQL} SELECT m.state, count(*) AS notices, CAST(sum(population) AS BIGINT) AS people FROM notice n JOIN municipality m USING (municipality_id) GROUP BY m.state",
)
def notice_municipality(spark, sf):
    places = municipalities(spark, sf).select("municipality_id", "population")
    return notices(spark, sf).join(places, "municipality_id").groupBy("state").agg(
        F.count(F.lit(1)).alias("notices"), F.sum("population").alias("people")
    )


@query(
    "J3_item_award_flat",
    f"WITH {_WITH_ID} SELECT it.item_id, award_seq, {r('unit_award')} AS unit_award FROM it LEFT JOIN award USING (item_id)",
)
def item_award_flat(spark, sf):
    rows = joins.items_with_awards_flat(item_rows(spark, sf).select("item_id"), award_rows(spark, sf))
    return rows.select("item_id", "award_seq", round_to(F.col("unit_award")).alias("unit_award"))


@query(
    "J4_item_nested_awards",
    f"WITH {_WITH_ID} SELECT it.item_id, count(award_seq) AS awards, {r('coalesce(min(unit_award), 0)')} AS lowest FROM it LEFT JOIN award USING (item_id) GROUP BY it.item_id",
)
def item_nested_awards(spark, sf):
    nested = joins.items_with_awards_nested(
        item_rows(spark, sf).select("item_id"), award_rows(spark, sf).select("item_id", "award_seq", "unit_award")
    )
    lowest = F.array_min(F.transform("awards", lambda a: a["unit_award"]))
    return nested.select(
        "item_id", F.size("awards").cast("long").alias("awards"), round_to(F.coalesce(lowest, F.lit(0.0))).alias("lowest")
    )


@query(
    "J5_award_item",
    f"WITH {_WITH_ID} SELECT award.supplier_id, description, count(*) AS awards FROM award JOIN it USING (item_id) GROUP BY ALL",
)
def award_item(spark, sf):
    rows = joins.awards_with_items(award_rows(spark, sf), item_rows(spark, sf).select("item_id", "description"))
    return rows.groupBy("supplier_id", "description").agg(F.count(F.lit(1)).alias("awards"))


def hashed_notices(spark, sf):
    return notices(spark, sf).withColumn(
        "notice_hash", notice_hash(F.col("source"), F.col("org_tax_id"), F.col("year"), F.col("sequence"))
    )


def linked_items(spark, sf, with_state=False):
    """Items that carry the notice hash, or for unit 'un' only its parts."""
    rows = items(spark, sf, with_state=with_state)
    shown = [c for c in rows.columns if c != "notice_id"]
    # ids and hashes are made behind the join, so that they don't cross the network
    parts = notices(spark, sf).select("notice_id", "source", "org_tax_id", "year", "sequence")
    own = notice_hash(F.col("source"), F.col("org_tax_id"), F.col("year"), F.col("sequence"))
    return rows.join(parts, "notice_id").select(
        *shown, _item_id(), F.when(F.col("unit") != "un", own).alias("notice_hash"), "org_tax_id", "year", "sequence"
    )


@query(
    "J6_notice_items",
    f"WITH {_WITH_ID} SELECT item_id, notice_id, CASE WHEN unit = 'un' THEN 'parts' ELSE 'hash' END AS link FROM it",
)
def notice_items(spark, sf):
    n = hashed_notices(spark, sf).select("notice_id", "notice_hash", "org_tax_id", "year", "sequence")
    return joins.notice_items(n, linked_items(spark, sf).select("item_id", "notice_hash", "org_tax_id", "year", "sequence")).select(
        "item_id", "notice_id", "link"
    )


@query(
    "J9_not_yet_opportunity",
    f"WITH {NOTICE_SQL} SELECT notice_id FROM notice WHERE municipality_id % 10 <> 4 AND municipality_id % 100 <> 7",
)
def not_yet_opportunity(spark, sf):
    from bidscope.checks.q_search import opportunities

    return joins.not_yet_opportunity(notices(spark, sf), opportunities(spark, sf), 7, 4).select("notice_id")


def _addressed(spark, sf):
    url = notice_url(F.col("org_tax_id"), F.col("year"), F.col("sequence"))
    return notices(spark, sf).withColumn("url", F.when(F.col("status") == "P", "https://other").otherwise(url))


@query(
    "J10_pending_items",
    f"""WITH {NOTICE_SQL} SELECT notice_id, org_tax_id AS tax_id, year FROM notice WHERE status <> 'P' AND sequence <> 0
  AND notice_id NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def pending_items(spark, sf):
    rows = joins.pending_items(_addressed(spark, sf), items(spark, sf, with_state=False))
    return rows.select("notice_id", "parts.tax_id", "parts.year")


@query(
    "J11_pending_awards",
    f"WITH {_WITH_ID} SELECT item_id FROM it WHERE quantity > 25 AND item_id NOT IN (SELECT item_id FROM award)",
)
def pending_awards(spark, sf):
    rows = item_rows(spark, sf).withColumn("has_award", F.col("quantity") > 25)
    return joins.pending_awards(rows, award_rows(spark, sf)).select("item_id")


@query(
    "J12_pending_prices",
    f"""WITH {NOTICE_SQL} SELECT notice_id, relevance FROM notice WHERE is_open AND notice_id NOT IN (SELECT event_id FROM events)""",
)
def pending_prices(spark, sf):
    done = table(spark, sf, "events").select(F.col("event_id").alias("notice_id"))
    return joins.pending(notices(spark, sf), done).select("notice_id", "relevance")


@query(
    "J12_pending_documents",
    f"WITH {NOTICE_SQL} SELECT notice_id FROM notice WHERE notice_id NOT IN (SELECT doc_id FROM documents)",
)
def pending_documents(spark, sf):
    done = table(spark, sf, "documents").select(F.col("doc_id").alias("notice_id"))
    return joins.pending(notices(spark, sf), done, only_open=False).select("notice_id")


@query(
    "U1_union_counts",
    """SELECT 'notices' AS name, count(*) AS rows_n FROM orders UNION ALL SELECT 'items', count(*) FROM lineitem
UNION ALL SELECT 'municipalities', count(*) FROM customer UNION ALL SELECT 'documents', count(*) FROM documents""",
)
def union_counts(spark, sf):
    from bidscope.plans.insight import table_counts

    return table_counts({
        "notices": table(spark, sf, "orders"), "items": table(spark, sf, "lineitem"),
        "municipalities": table(spark, sf, "customer"), "documents": table(spark, sf, "documents"),
    })


@query(
    "U2_set_intersection",
    f"""WITH {PLAIN_ITEM_SQL}, s AS (SELECT part_id, list(DISTINCT platform) FILTER (unit = 'un') AS a, list(DISTINCT platform) FILTER (unit = 'kg') AS b FROM item GROUP BY part_id)
SELECT part_id, CAST(coalesce(len(list_intersect(a, b)), 0) AS INTEGER) AS shared FROM s""",
)
def set_intersection(spark, sf):
    sets = items(spark, sf, with_state=False).groupBy("part_id").agg(
        F.collect_set(F.when(F.col("unit") == "un", F.col("platform"))).alias("a"),
        F.collect_set(F.when(F.col("unit") == "kg", F.col("platform"))).alias("b"),
    )
    return sets.select("part_id", F.size(F.array_intersect("a", "b")).alias("shared"))


@query(
    "U3_set_union",
    f"""WITH {PLAIN_ITEM_SQL} SELECT supplier_id, array_to_string(list_sort(list_distinct(list(code) || list(unit))), ',') AS labels FROM item GROUP BY supplier_id""",
)
def set_union(spark, sf):
    sets = items(spark, sf, with_state=False).groupBy("supplier_id").agg(
        F.collect_set("code").alias("a"), F.collect_set("unit").alias("b")
    )
    return sets.select("supplier_id", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("labels"))


@query("U4_not_yet_processed", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def not_yet_processed(spark, sf):
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


_LINE = "l_partkey, l_suppkey"


@query(
    "W4_dedup_best_score",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS score FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, {_LINE}) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedup_best_score(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("score"))
    return latest_per_key(rows, ["l_orderkey", "l_linenumber"], [F.col("score").desc(), F.col("l_partkey"), F.col("l_suppkey")])


@query(
    "W5_dedup_first",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, {_LINE}) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedup_first(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return skew.first_per_key(rows, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey")])


@query(
    "W7_topk_per_ref",
    f"""SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, rn AS position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_partkey
  ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey) AS INTEGER) AS rn FROM lineitem) WHERE rn <= 30""",
)
def topk_per_ref(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    order = [F.col("l_shipdate").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    return skew.top_k(rows, ["l_partkey"], order, 30, "position").drop("l_shipdate")


@query(
    "W8_latest_config_per_org",
    "SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events WHERE event_type <> 'error') WHERE rn = 1",
)
def latest_config_per_org(spark, sf):
    rows = table(spark, sf, "events").filter("event_type <> 'error'")
    return skew.first_per_key(rows, ["user_id"], [F.col("ts").desc(), F.col("event_id")]).select("user_id", "event_type", "ts")


@query(
    "W10_min_award_per_item",
    f"WITH {_WITH_ID} SELECT item_id, {r('min(unit_award)')} AS lowest, {r('arg_min(unit_award, award_seq)')} AS first_award FROM award WHERE unit_award > 0 GROUP BY item_id",
)
def min_award_per_item(spark, sf):
    from bidscope.plans.pricing import best_awards

    rows = best_awards(award_rows(spark, sf))
    return rows.select(
        "item_id", round_to(F.col("best_award")).alias("lowest"), round_to(F.col("first_award")).alias("first_award")
    )
