"""Searches, sort orders and paging over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.checks.registry import query
from bidscope.checks.star import (
    AS_OF, ITEM_SQL, MUNICIPALITY_SQL, NOTICE_SQL, as_of, index_folder, items, municipalities, notices, r, table,
)
from bidscope.functions import scores
from bidscope.functions.keys import place_label
from bidscope.functions.text import normalize_text, words
from bidscope.operators import search, text_index

_RANK = "CASE relevance WHEN 'ALTA' THEN 0 WHEN 'MEDIA' THEN 1 ELSE 2 END"
_DEFAULT_ORDER = f"{_RANK}, published_at DESC, notice_id"


def _scored(spark, sf):
    """Notices with keywords, a score and an urgency."""
    n = notices(spark, sf)
    return n.withColumns({
        "keywords": F.split(F.lower("subject"), " "),
        "score": F.when(F.col("status") != "P", F.round(F.col("estimate") / 5000, 1)),
        "urgency": scores.urgency(F.col("closes_at"), as_of()),
        "dispute_mode_id": F.col("modality_id"),
    })


_SCORED = f"{NOTICE_SQL}, scored AS (SELECT *, CASE WHEN status <> 'P' THEN round(estimate / 5000, 1) END AS score FROM notice)"


def _reads(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("event_id").alias("notice_id"))


@query(
    "P6_prospect_candidates",
    f"""WITH {NOTICE_SQL}, {MUNICIPALITY_SQL} SELECT notice_id, population, microregion_id FROM notice n JOIN municipality m USING (municipality_id)
WHERE n.state IN ('NATION_1', 'NATION_2', 'NATION_8') AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY AND population <= 91692 AND microregion_id IN (1, 8)""",
)
def prospect_candidates(spark, sf):
    rows = search.prospect_candidates(
        notices(spark, sf), municipalities(spark, sf), ["NATION_1", "NATION_2", "NATION_8"],
        as_of() - F.expr("interval 400 days"), 91692, [1, 8],
    )
    return rows.select("notice_id", "population", "microregion_id")


_P7 = """state IN ('NATION_1', 'NATION_2', 'NATION_3') AND is_open AND contains(lower(subject), 'mach')
  AND modality_id IN (1, 2, 4) AND NOT contains(lower(subject), 'high')"""
_ORG = search.OrgFilters(modalities=[3], exclusions=["HIGH"], domains={"modalidade_contratacao": [1, 2, 4]})
_FILTERS = dict(org=_ORG, states=["NATION_1", "NATION_2", "NATION_3"], is_open=True, subject_like="Mach")


@query(
    "P7_search_notices",
    f"""WITH {NOTICE_SQL}, hit AS (SELECT * FROM notice WHERE {_P7})
SELECT notice_id, subject, relevance, published_at, notice_id IN (SELECT event_id FROM events WHERE user_id = 7) AS is_read,
  (SELECT count(*) FROM hit) AS total FROM hit ORDER BY {_DEFAULT_ORDER} LIMIT 20 OFFSET 20""",
)
def search_notices(spark, sf):
    shown, total = search.search_notices(
        notices(spark, sf), _reads(spark, sf), 7, order="relevance", limit=20, offset=20, **_FILTERS
    )
    return shown.select("notice_id", "subject", "relevance", "published_at", "is_read").withColumn(
        "total", total.scalar()
    )


@query("P7_filter_notices", f"WITH {NOTICE_SQL} SELECT notice_id, subject FROM notice WHERE {_P7}")
def filter_notices(spark, sf):
    return search.filter_notices(notices(spark, sf), **_FILTERS).select("notice_id", "subject")


@query(
    "P8_org_domain_guard",
    f"WITH {NOTICE_SQL} SELECT notice_id, modality_id, status_id FROM notice WHERE modality_id = 2 AND status_id = 1",
)
def org_domain_guard(spark, sf):
    org = search.OrgFilters(
        domains={"modalidade_contratacao": [1, 2], "modo_disputa": [1], "situacao_item_contratacao": [1, 2]}
    )
    # dispute mode 5 is not one of the organisation's, so that filter is ignored
    rows = search.filter_notices(
        _scored(spark, sf), org, modality_id=2, dispute_mode_id=5, status_id=1, guard_domains=True
    )
    return rows.select("notice_id", "modality_id", "status_id")


_P9 = f"""WITH {NOTICE_SQL} SELECT notice_id, estimate FROM notice WHERE is_open AND estimate BETWEEN 100000 AND 300000
  AND list_contains(string_split(lower(subject), ' '), 'furniture') AND contains(lower(subject), 'urg') ORDER BY estimate DESC, notice_id LIMIT 50"""


def _flexible(spark, sf, index=None):
    rows = search.search_notices_flexible(
        _scored(spark, sf), ["furniture"], is_open=True, min_value=100000.0, max_value=300000.0,
        keyword="URG", order="value", limit=50, index=index,
    )
    return rows.select("notice_id", "estimate")


@query("P9_search_notices_flexible", _P9)
def search_notices_flexible(spark, sf):
    return _flexible(spark, sf)


@query("P9_search_notices_indexed", _P9)
def search_notices_indexed(spark, sf):
    path = index_folder(spark, "subjects")
    text_index.write_index(notices(spark, sf), F.col("notice_id"), words(normalize_text(F.col("subject"))), path)
    return _flexible(spark, sf, path)


@query(
    "P10_search_items",
    f"""WITH {ITEM_SQL} SELECT notice_id, item_no, part_id, supplier_id, estimate, {r('coalesce(award, 0)')} AS award FROM item
WHERE state = 'NATION_3' AND platform_id = 2 AND estimate BETWEEN 5000 AND 60000 AND list_contains(string_split(description, ' '), 'red')
ORDER BY estimate, notice_id, item_no, part_id, supplier_id LIMIT 50""",
)
def search_items(spark, sf):
    order = [F.col(c) for c in ("estimate", "notice_id", "item_no", "part_id", "supplier_id")]
    rows = search.search_items(
        items(spark, sf), order, 50, state="NATION_3", platform_id=2, min_value=5000.0, max_value=60000.0,
        text_terms=["red"],
    )
    return rows.select(
        "notice_id", "item_no", "part_id", "supplier_id", "estimate",
        scores.round_to(F.coalesce("award", F.lit(0.0))).alias("award"),
    )


def opportunities(spark, sf):
    """Every notice scored for one of ten organisations by its customer."""
    return _scored(spark, sf).select(
        (F.col("municipality_id") % 10).alias("org_id"), (F.col("municipality_id") % 100).alias("user_id"),
        "notice_id", "score", "relevance", "urgency",
    )


_OPP = f"""{_SCORED}, {MUNICIPALITY_SQL}, opp AS (SELECT s.*, m.microregion_id, s.municipality_id % 10 AS org_id FROM scored s
  JOIN municipality m USING (municipality_id))"""


@query(
    "P11_search_org_opportunities",
    f"""WITH {_OPP} SELECT notice_id, score, relevance, true AS prospected FROM opp WHERE org_id = 3 AND is_open AND relevance = 'ALTA'
  AND microregion_id IN (2, 4, 6, 8, 10) ORDER BY score DESC NULLS LAST, published_at DESC, notice_id LIMIT 30 OFFSET 10""",
)
def search_org_opportunities(spark, sf):
    rows = search.search_org_opportunities(
        opportunities(spark, sf), notices(spark, sf), municipalities(spark, sf), 3, relevance="ALTA", is_open=True,
        microregions=[2, 4, 6, 8, 10], limit=30, offset=10,
    )
    return rows.select("notice_id", "score", "relevance", "prospected")


@query(
    "P11_org_without_opportunities",
    f"""WITH {NOTICE_SQL} SELECT notice_id, CAST(NULL AS DOUBLE) AS score, 'BAIXA' AS relevance, false AS prospected FROM notice
WHERE state = 'NATION_5' ORDER BY published_at DESC, notice_id LIMIT 25""",
)
def org_without_opportunities(spark, sf):
    rows = search.search_org_opportunities(
        opportunities(spark, sf), notices(spark, sf), municipalities(spark, sf), 99, states=["NATION_5"], limit=25
    )
    return rows.select("notice_id", "score", "relevance", "prospected")


@query(
    "P12_notices_since",
    f"WITH {NOTICE_SQL} SELECT notice_id, relevance FROM notice WHERE is_open AND created_at >= TIMESTAMP '2000-01-01'",
)
def notices_since(spark, sf):
    since = F.lit("2000-01-01").cast("timestamp")
    return search.notices_since(notices(spark, sf), since).select("notice_id", "relevance")


@query(
    "P18_simple_counts",
    f"WITH {NOTICE_SQL} SELECT (SELECT count(*) FROM notice WHERE is_open) AS open_notices, (SELECT count(*) FROM events WHERE event_type <> 'error') AS active_watches",
)
def simple_counts(spark, sf):
    watches = table(spark, sf, "events").withColumn("active", F.col("event_type") != "error")
    open_count = notices(spark, sf).agg(F.count_if("is_open").alias("open_notices"))
    return open_count.withColumn(
        "active_watches", search.active_watches(watches).agg(F.count(F.lit(1))).scalar()
    )


def _ranked_sql(order: str) -> str:
    return f"WITH {_SCORED} SELECT notice_id, score FROM scored ORDER BY {order} LIMIT 100"


_ORDERS = {
    "published": "published_at DESC, notice_id",
    "value": "estimate DESC, notice_id",
    "municipality": "municipality, published_at DESC, notice_id",
    "score": "score DESC NULLS LAST, published_at DESC, notice_id",
    "relevance": _DEFAULT_ORDER,
}


def _register_order(mode: str, order: str) -> None:
    @query(f"O1_order_by_{mode}", _ranked_sql(order))
    def ordered(spark, sf):
        rows = search.page(_scored(spark, sf), search.order_columns(mode), 100)
        return rows.select("notice_id", "score")


for _mode, _order in _ORDERS.items():
    _register_order(_mode, _order)


@query(
    "O2_page",
    f"WITH {NOTICE_SQL} SELECT notice_id, (SELECT count(*) FROM notice WHERE is_open) AS total FROM notice WHERE is_open ORDER BY published_at DESC, notice_id LIMIT 50 OFFSET 100",
)
def page(spark, sf):
    rows = notices(spark, sf).filter("is_open")
    total = rows.agg(F.count(F.lit(1))).scalar()
    return search.page(rows, search.order_columns("published"), 50, 100).select("notice_id").withColumn("total", total)


@query(
    "O2_seek_pages",
    f"WITH {NOTICE_SQL} SELECT notice_id, published_at FROM notice WHERE is_open ORDER BY published_at DESC, notice_id LIMIT 50 OFFSET 100",
)
def seek_pages(spark, sf):
    """The third page, each found behind the last row of the page before."""
    rows = notices(spark, sf).filter("is_open").select("notice_id", "published_at")
    order, after = [("published_at", True), ("notice_id", False)], None
    for _ in range(2):
        after = search.seek_page(rows, order, 50, after).tail(1)[0]
    return search.seek_page(rows, order, 50, after)


@query(
    "O3_prospect_order",
    f"WITH {_SCORED} SELECT notice_id, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, published_at DESC, notice_id) AS INTEGER) AS position FROM scored QUALIFY position <= 200",
)
def prospect_order(spark, sf):
    rows = search.page(_scored(spark, sf), search.order_columns("score"), 200)
    # the position is taken over the 200 rows of the page only
    from pyspark.sql import Window

    position = F.row_number().over(Window.orderBy(*search.order_columns("score")))
    return rows.withColumn("position", position).select("notice_id", "score", "position")


@query(
    "J2_open_notices_view",
    f"""WITH {NOTICE_SQL}, {MUNICIPALITY_SQL} SELECT notice_id, m.name || '/' || m.state AS place, population FROM notice n LEFT JOIN municipality m USING (municipality_id) WHERE is_open""",
)
def open_notices_view(spark, sf):
    rows = search.open_notices(notices(spark, sf), municipalities(spark, sf))
    return rows.select("notice_id", place_label(F.col("municipality"), F.col("state")).alias("place"), "population")


@query(
    "J8_read_flag",
    f"WITH {NOTICE_SQL} SELECT notice_id, notice_id IN (SELECT event_id FROM events WHERE user_id = 3) AS is_read FROM notice",
)
def read_flag(spark, sf):
    return search.with_read_flag(notices(spark, sf), _reads(spark, sf), 3).select("notice_id", "is_read")
