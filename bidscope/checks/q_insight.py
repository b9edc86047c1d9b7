"""Dashboards, suppliers, sessions and dossiers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.checks.q_joins import AWARD_SQL, award_rows, hashed_notices, item_rows, linked_items
from bidscope.checks.q_market import _GROUPS_SELECT, _groups_dedup
from bidscope.checks.q_scalars import trigram_sql
from bidscope.checks.registry import query
from bidscope.checks.star import AS_OF, ITEM_SQL, MUNICIPALITY_SQL, NOTICE_SQL, as_of, index_folder, items, municipalities, notices, r, rsum, stats_sql, table
from bidscope.functions.scores import round_to
from bidscope.operators import text_index
from bidscope.plans import dossier, insight, market, session
from bidscope.plans.pricing import best_awards

_ITEM_ID = "notice_id || '-' || item_no || '-' || part_id || '-' || supplier_id"
_BASE = f"{ITEM_SQL}, it AS (SELECT *, {_ITEM_ID} AS item_id, estimate * quantity AS total_estimate FROM item), {AWARD_SQL}"


def _items(spark, sf):
    return item_rows(spark, sf, with_state=True).withColumn("total_estimate", F.col("estimate") * F.col("quantity"))


_FLAT = "flat AS (SELECT it.*, a.unit_award, a.total_award, a.discount, coalesce(a.unit_award, it.estimate) AS reference FROM it LEFT JOIN award a USING (item_id))"


def _lookup(spark, sf, **wanted):
    order = ["notice_id", "item_no", "part_id", "supplier_id", "award_seq"]
    return insight.price_lookup(_items(spark, sf), award_rows(spark, sf), order, **wanted)


@query(
    "D17_price_lookup_by_code",
    f"""WITH {_BASE}, {_FLAT} SELECT count(*) AS total, {r('min(reference)')} AS minimum, {r('max(reference)')} AS maximum, {r('avg(reference)')} AS mean,
  {r('quantile_cont(reference, 0.5)')} AS median, {r('avg(discount)')} AS mean_discount FROM flat
WHERE code = 'ECONOMY' AND created_at >= TIMESTAMP '1998-01-01'""",
)
def price_lookup_by_code(spark, sf):
    return _lookup(spark, sf, code="ECONOMY", since=F.lit("1998-01-01").cast("timestamp")).summary


_ALIKE = f"""alike AS (SELECT d FROM (SELECT DISTINCT description AS d FROM item) WHERE
  len(list_intersect({trigram_sql('d')}, {trigram_sql("'red widgets'")})) / len(list_distinct(list_concat({trigram_sql('d')}, {trigram_sql("'red widgets'")}))) >= 0.3)"""


_BY_TEXT = f"""WITH {_BASE}, {_FLAT}, {_ALIKE} SELECT platform, {r('avg(reference)')} AS mean_unit, count(*) AS items FROM flat JOIN alike ON d = description GROUP BY platform"""


@query("D17_price_lookup_by_text", _BY_TEXT)
def price_lookup_by_text(spark, sf):
    return _lookup(spark, sf, text="red widgets").platforms


@query("D17_price_lookup_by_index", _BY_TEXT)
def price_lookup_by_index(spark, sf):
    path = index_folder(spark, "descriptions")
    text_index.write_trigram_index(items(spark, sf), "description", path)
    return _lookup(spark, sf, text="red widgets", index=path).platforms


@query(
    "D17_cheapest_items",
    f"""WITH {_BASE}, {_FLAT}, {_ALIKE} SELECT item_id, {r('reference')} AS reference, state FROM flat JOIN alike ON d = description
WHERE state = 'NATION_2' ORDER BY reference, notice_id, item_no, part_id, supplier_id LIMIT 30""",
)
def cheapest_items(spark, sf):
    rows = _lookup(spark, sf, text="red widgets", state="NATION_2").cheapest
    return rows.select("item_id", round_to(F.col("reference")).alias("reference"), "state")


@query(
    "D18_top_suppliers",
    f"""WITH {_BASE} SELECT a.supplier_id, count(*) AS wins, {rsum('total_award')} AS total, {r('avg(unit_award)')} AS mean_unit, {r('avg(discount)')} AS mean_discount,
  array_to_string(list_sort(list(DISTINCT state)), ',') AS states, count(DISTINCT municipality) AS municipalities
FROM award a JOIN it USING (item_id) WHERE total_award > 0 AND awarded_at >= TIMESTAMP '1997-01-01' GROUP BY a.supplier_id
ORDER BY wins DESC, total DESC, a.supplier_id LIMIT 20""",
)
def top_suppliers(spark, sf):
    rows = insight.top_suppliers(award_rows(spark, sf), _items(spark, sf), F.lit("1997-01-01").cast("timestamp"))
    return rows.withColumn("states", F.array_join("states", ","))


@query(
    "D19_platform_compare",
    f"""WITH {_BASE}, {_FLAT} SELECT platform, platform_id, count(*) AS items, {r('avg(reference)')} AS mean_unit, {r('avg(discount)')} AS mean_discount,
  {rsum('coalesce(total_award, total_estimate)')} AS total, count(DISTINCT municipality) AS municipalities FROM flat GROUP BY ALL""",
)
def platform_compare(spark, sf):
    return insight.platform_compare(_items(spark, sf), award_rows(spark, sf))


@query(
    "D20_report_rollup",
    f"""WITH {NOTICE_SQL} SELECT 'relevance' AS kind, relevance AS label, count(*) AS notices, {rsum('estimate')} AS total FROM notice GROUP BY relevance
UNION ALL SELECT 'state', state, count(*), {rsum('estimate')} FROM notice GROUP BY state
UNION ALL SELECT 'modality', modality, count(*), {rsum('estimate')} FROM notice GROUP BY modality
UNION ALL SELECT 'total', 'TOTAL', count(*), {rsum('estimate')} FROM notice""",
)
def report_rollup(spark, sf):
    return insight.report_rollup(notices(spark, sf))


@query(
    "D21_dashboard_counts",
    f"""WITH {NOTICE_SQL}, o AS (SELECT * FROM notice WHERE is_open)
SELECT 'relevance' AS kind, relevance AS label, count(*) AS notices, {rsum('estimate')} AS total FROM o GROUP BY relevance
UNION ALL SELECT 'state', state, count(*), {rsum('estimate')} FROM o GROUP BY state
UNION ALL SELECT 'open', 'all', count(*), {rsum('estimate')} FROM o""",
)
def dashboard_counts(spark, sf):
    return insight.dashboard_counts(notices(spark, sf))


STATUSES = ["identificada", "analisando", "ganha", "perdida", "proposta_enviada"]


def user_opportunities(spark, sf):
    """Opportunities of every notice: users by hundred, organisations by ten, modality as status."""
    n = notices(spark, sf)
    status = F.element_at(F.array(*map(F.lit, STATUSES)), F.col("modality_id"))
    return n.select(
        F.concat(F.lit("op-"), F.col("notice_id").cast("string")).alias("opportunity_id"), "notice_id",
        (F.col("municipality_id") % 100).alias("user_id"), (F.col("municipality_id") % 10).alias("org_id"),
        status.alias("status"), F.when(F.col("small_business"), F.col("estimate") * 0.5).alias("proposal_value"),
        (F.col("published_at") + F.expr("interval 20 days")).cast("date").alias("internal_due"), "closes_at",
        F.col("relevance"), F.when(F.col("status") != "P", F.round(F.col("estimate") / 5000, 1)).alias("score"),
    )


_STATUS_SQL = "['identificada', 'analisando', 'ganha', 'perdida', 'proposta_enviada'][modality_id]"
OPP_SQL = f"""opp AS (SELECT 'op-' || notice_id AS opportunity_id, notice_id, municipality_id % 100 AS user_id, municipality_id % 10 AS org_id,
  {_STATUS_SQL} AS status, CASE WHEN small_business THEN estimate * 0.5 END AS proposal_value, CAST(published_at + INTERVAL 20 DAY AS DATE) AS internal_due,
  closes_at, relevance, CASE WHEN notice.status <> 'P' THEN round(estimate / 5000, 1) END AS score FROM notice)"""


def _deadlines(spark, sf):
    return table(spark, sf, "events").select(
        (F.col("user_id") % 100).alias("user_id"), F.col("event_id").alias("notice_id"), F.col("event_type").alias("kind"),
        F.floor("value").cast("long").alias("days_left"), F.col("ts").cast("date").alias("due_date"),
        (F.col("event_type") == "view").alias("is_read"),
    )


_MINE = "(user_id = 7 OR org_id = 3)"


@query(
    "D22_dashboard_summary",
    f"""WITH {NOTICE_SQL}, {OPP_SQL}, mine AS (SELECT * FROM opp WHERE {_MINE}), o AS (SELECT * FROM notice WHERE is_open)
SELECT 'pipeline' AS metric, status AS label, CAST(count(*) AS DOUBLE) AS value FROM mine GROUP BY status
UNION ALL SELECT 'pipeline_value', NULL, {rsum('coalesce(proposal_value, estimate)')} FROM mine JOIN notice USING (notice_id)
  WHERE mine.status IN ('identificada', 'analisando', 'preparando_proposta', 'proposta_enviada')
UNION ALL (SELECT 'urgent_deadline', CAST(event_id AS VARCHAR), floor(value) FROM events WHERE user_id % 100 = 7 AND event_type <> 'view'
  ORDER BY floor(value), CAST(ts AS DATE), event_id, event_type LIMIT 5)
UNION ALL SELECT 'unread_alerts', NULL, count(*) FROM events WHERE user_id % 100 = 7 AND event_type <> 'view'
UNION ALL (SELECT 'new_high', CAST(notice_id AS VARCHAR), estimate FROM o WHERE relevance = 'ALTA'
  AND municipality_id % 100 <> 7 AND municipality_id % 10 <> 3 ORDER BY published_at DESC, notice_id LIMIT 5)
UNION ALL (SELECT 'by_state', state, count(*) FROM o GROUP BY state ORDER BY count(*) DESC, state LIMIT 8)
UNION ALL (SELECT 'by_modality', modality, count(*) FROM o GROUP BY modality ORDER BY count(*) DESC, modality LIMIT 5)
UNION ALL SELECT 'closing_week', NULL, count(*) FROM o WHERE closes_at BETWEEN TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY
UNION ALL SELECT 'open_total', NULL, count(*) FROM o
UNION ALL SELECT 'last_collection', NULL, epoch(max(published_at)) FROM notice""",
)
def dashboard_summary(spark, sf):
    deadlines = _deadlines(spark, sf)
    tiles = insight.dashboard_summary(
        notices(spark, sf), user_opportunities(spark, sf), deadlines, deadlines, 7, 3, as_of()
    )
    return insight.union_tiles(tiles)


@query(
    "D23_supplier_profile",
    f"""WITH {_BASE}, j AS (SELECT a.supplier_id AS sid, a.unit_award, a.award_seq, it.platform, it.state, it.item_id FROM award a JOIN it USING (item_id)),
b AS (SELECT sid, arg_max(item_id, unit_award) AS best FROM j GROUP BY sid)
SELECT sid AS supplier_id, count(*) AS wins, {rsum('unit_award')} AS total_unit, array_to_string(list_sort(list(DISTINCT platform)), ',') AS platforms,
  array_to_string(list_sort(list(DISTINCT state)), ',') AS states, CAST(least(count(*), 50) AS INTEGER) AS listed, any_value(best) AS best
FROM j JOIN b USING (sid) GROUP BY sid""",
)
def supplier_profile(spark, sf):
    rows = insight.supplier_profile(award_rows(spark, sf), _items(spark, sf), ["item_id", "award_seq"])
    return rows.select(
        "supplier_id", "wins", "total_unit", F.array_join("platforms", ",").alias("platforms"),
        F.array_join("states", ",").alias("states"), F.size("items").alias("listed"), F.col("items")[0]["item_id"].alias("best"),
    )


@query(
    "D24_items_by_platform_bundle",
    f"""WITH {_BASE}, c AS (SELECT * FROM it WHERE state = 'NATION_4' AND list_contains(string_split(description, ' '), 'bolt')
  ORDER BY estimate, notice_id, item_no, part_id, supplier_id LIMIT 100)
SELECT platform, CAST(count(*) AS INTEGER) AS items, {r('min(estimate)')} AS cheapest FROM c GROUP BY platform""",
)
def items_by_platform_bundle(spark, sf):
    order = [F.col(c) for c in ("estimate", "notice_id", "item_no", "part_id", "supplier_id")]
    rows = insight.items_by_platform(_items(spark, sf), order, 100, state="NATION_4", text_terms=["bolt"])
    return rows.select("platform", F.size("items").alias("items"), round_to(F.col("items")[0]["estimate"]).alias("cheapest"))


def org_configs(spark, sf):
    """One configuration per organisation, derived from customers: their states and segments."""
    m = municipalities(spark, sf)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("municipality_id"), "c_mktsegment")
    return m.join(c, "municipality_id").groupBy((F.col("municipality_id") % 10).alias("org_id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("region_id") == F.col("municipality_id") % 5, F.col("state")))).alias("states"),
        F.array_sort(F.collect_set("c_mktsegment")).alias("keywords"),
        F.array_sort(F.collect_set(F.when(F.col("population") > 190000, F.col("name")))).alias("exclusions"),
        F.array_sort(F.collect_set((F.col("region_id") + 1).cast("int"))).alias("modalities"),
        F.array(F.lit("PNCP"), F.lit("TCE_RJ")).alias("sources"),
        F.max("population").alias("max_population"),
    )


def org_domains(spark, sf):
    rows = org_configs(spark, sf).select("org_id", "modalities")
    return rows.select(
        "org_id", F.explode(F.array(F.lit("modalidade_contratacao"), F.lit("modo_disputa"))).alias("domain"),
        F.transform("modalities", lambda x: x + 6).alias("codes"),
    )


_CFG = f"""{MUNICIPALITY_SQL}, cfg AS (SELECT municipality_id % 10 AS org_id,
  list_sort(list(DISTINCT state) FILTER (region_id = municipality_id % 5)) AS states, list_sort(list(DISTINCT c_mktsegment)) AS keywords,
  list_sort(list(DISTINCT name) FILTER (population > 190000)) AS exclusions, list_sort(list(DISTINCT region_id + 1)) AS modalities, max(population) AS max_population
  FROM municipality JOIN customer ON c_custkey = municipality_id GROUP BY municipality_id % 10)"""


@query(
    "D28_filter_facets",
    f"""WITH {NOTICE_SQL}, {_CFG} SELECT org_id, coalesce(array_to_string(list_sort(list_intersect(states, (SELECT list(DISTINCT state) FROM notice))), ','), '') AS states,
  array_to_string(keywords, ',') AS keywords, coalesce(array_to_string(exclusions, ','), '') AS exclusions,
  'modalidade_contratacao,modo_disputa' AS domains FROM cfg""",
)
def filter_facets(spark, sf):
    rows = insight.filter_facets(notices(spark, sf), org_configs(spark, sf), org_domains(spark, sf))
    join = lambda c: F.array_join(c, ",")
    return rows.select(
        "org_id", join("states").alias("states"), join("keywords").alias("keywords"), join("exclusions").alias("exclusions"),
        join(F.array_sort(F.map_keys("domains"))).alias("domains"),
    )


@query(
    "D29_merged_collect_config",
    f"""WITH {_CFG} SELECT array_to_string(list_sort(list_distinct(flatten(list(states)))), ',') AS states,
  array_to_string(list_sort(list_distinct(flatten(list(list_concat(modalities, list_transform(modalities, lambda x: x + 6)))))), ',') AS modalities,
  'PNCP,TCE_RJ' AS sources, max(max_population) AS max_population FROM cfg""",
)
def merged_collect_config(spark, sf):
    row = insight.merged_collect_config(org_configs(spark, sf), org_domains(spark, sf))
    return row.select(
        F.array_join("states", ",").alias("states"), F.array_join(F.col("modalities").cast("array<string>"), ",").alias("modalities"),
        F.array_join("sources", ",").alias("sources"), "max_population",
    )


@query(
    "D30_org_prospect_stats",
    f"""WITH {NOTICE_SQL}, {OPP_SQL} SELECT org_id, count(*) AS total, count(*) FILTER (relevance = 'ALTA') AS high, count(*) FILTER (relevance = 'MEDIA') AS medium,
  count(*) FILTER (relevance = 'BAIXA') AS low FROM opp GROUP BY org_id""",
)
def org_prospect_stats(spark, sf):
    return insight.org_prospect_stats(user_opportunities(spark, sf))


@query(
    "D31_ops_by_state",
    f"""WITH {NOTICE_SQL} SELECT state, count(*) AS total, count(*) FILTER (is_open) AS open,
  count(*) FILTER (notice_id IN (SELECT l_orderkey FROM lineitem)) AS with_items FROM notice GROUP BY state""",
)
def ops_by_state(spark, sf):
    from bidscope.operators.tables import mark_collected

    n = notices(spark, sf).withColumns({"notice_hash": F.col("notice_id").cast("string"), "items_collected": F.lit(False)})
    present = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("notice_hash"))
    return insight.notices_by_state(mark_collected(n, present))


@query(
    "D31_ops_by_platform",
    "SELECT 'P' || (l_suppkey % 7) AS platform, count(*) AS items FROM lineitem GROUP BY ALL",
)
def ops_by_platform(spark, sf):
    return insight.items_by_platform_counts(items(spark, sf, with_state=False))


@query(
    "D31_microregion_check",
    """SELECT n_name AS state, count(*) AS microregions, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS linked
FROM nation GROUP BY n_name, n_nationkey""",
)
def microregion_check(spark, sf):
    regions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("microregion_id"), F.col("n_name").alias("state"))
    return insight.microregion_check(regions, municipalities(spark, sf))


@query(
    "D32_award_coverage",
    f"""WITH {_BASE}, p AS (SELECT item_id, count(*) AS n FROM award WHERE unit_award > 0 GROUP BY item_id)
SELECT platform, count(*) AS items, count(n) AS awarded_items, {r('count(n) / count(*) * 100', 1)} AS share, CAST(coalesce(sum(n), 0) AS BIGINT) AS awards
FROM it LEFT JOIN p USING (item_id) GROUP BY platform""",
)
def award_coverage(spark, sf):
    return insight.award_coverage(_items(spark, sf), award_rows(spark, sf))


@query(
    "D34_deadline_digest",
    f"""WITH {NOTICE_SQL}, a AS (SELECT user_id % 100 AS user_id, event_id AS notice_id, CASE WHEN event_type = 'view' THEN 'prazo_interno' ELSE event_type END AS kind,
    CAST(floor(value) AS BIGINT) AS days_left FROM events),
l AS (SELECT a.*, row_number() OVER (PARTITION BY user_id ORDER BY days_left, notice_id, kind) AS rn,
  concat_ws(' | ', CASE days_left WHEN 0 THEN 'HOJE' WHEN 1 THEN 'AMANHÃ' ELSE 'em ' || days_left || ' dias' END, coalesce(municipality, '') || '/' || coalesce(state, ''),
    CASE WHEN kind = 'prazo_interno' THEN 'Prazo interno' ELSE 'Encerramento' END, subject[1:80]) AS line FROM a LEFT JOIN notice USING (notice_id))
SELECT user_id, count(*) AS alerts, string_agg(line, ' # ' ORDER BY rn) FILTER (rn <= 10) AS lines FROM l GROUP BY user_id""",
)
def deadline_digest(spark, sf):
    alerts = _deadlines(spark, sf).withColumn("kind", F.when(F.col("kind") == "view", "prazo_interno").otherwise(F.col("kind")))
    rows = insight.deadline_digest(alerts, notices(spark, sf))
    return rows.withColumn("lines", F.array_join("lines", " # "))


@query(
    "D34_high_opportunity_digest",
    f"""WITH {NOTICE_SQL}, {OPP_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY score DESC NULLS LAST, notice_id) AS rn FROM opp WHERE relevance = 'ALTA')
SELECT org_id, count(*) AS high, string_agg(municipality || '/' || state, ',' ORDER BY rn) FILTER (rn <= 10) AS places FROM h JOIN notice USING (notice_id) GROUP BY org_id""",
)
def high_opportunity_digest(spark, sf):
    rows = insight.high_opportunity_digest(user_opportunities(spark, sf), notices(spark, sf))
    return rows.select("org_id", "high", F.array_join(F.transform("items", lambda i: i["place"]), ",").alias("places"))


@query(
    "D35_synonym_candidates",
    """SELECT DISTINCT lower(array_to_string(string_split_regex(trim(text), '\\s+')[1:6], ' ')) AS description FROM documents
WHERE length(trim(text)) > 5""",
)
def synonym_candidates(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("text").alias("description"), F.lit(1.0).alias("estimate"))
    return insight.synonym_candidates(rows)


@query(
    "D36_merge_synonyms",
    """WITH prop AS (SELECT lower(split_part(p_name, ' ', 1)) AS variant, lower(split_part(p_name, ' ', 2)) AS canonical FROM part),
ex AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS variant, 'cor' AS canonical FROM part WHERE p_name LIKE 'red %' OR p_name LIKE 'blue %')
SELECT variant, canonical FROM ex UNION ALL SELECT variant, min(canonical) FROM prop WHERE variant <> canonical AND variant <> '' AND canonical <> ''
  AND variant NOT IN (SELECT variant FROM ex) GROUP BY variant""",
)
def merge_synonyms(spark, sf):
    word = F.split("p_name", " ")
    part = table(spark, sf, "part")
    proposed = part.select(F.upper(word[0]).alias("variant"), F.concat(F.lit(" "), word[1]).alias("canonical"))
    existing = part.filter("p_name LIKE 'red %' OR p_name LIKE 'blue %'").select(word[0].alias("variant"), F.lit("cor").alias("canonical")).distinct()
    return insight.merge_synonyms(existing, proposed)


# ---------------------------------------------------------------- sessions


def _session(spark, sf):
    chosen = notices(spark, sf).filter("modality_id <= 3").select("notice_id", (F.col("modality_id") == 3).alias("excluded"))
    dropped = item_rows(spark, sf).filter("item_no = 4").select("item_id")
    its = linked_items(spark, sf).drop("best_award")
    return session.session_items(hashed_notices(spark, sf), its, chosen, dropped), chosen


_SESSION = f"""{NOTICE_SQL}, {_BASE}, chosen AS (SELECT notice_id, modality_id = 3 AS excluded FROM notice WHERE modality_id <= 3),
sess AS (SELECT it.* EXCLUDE (state, municipality, municipality_id), n.subject, n.relevance, n.municipality, n.state, it.item_no = 4 AS excluded FROM it JOIN notice n USING (notice_id)
  WHERE notice_id IN (SELECT notice_id FROM chosen WHERE NOT excluded) AND it.estimate > 0)"""


@query("J7_session_items", f"WITH {_SESSION} SELECT item_id, notice_id, subject, relevance, item_no, excluded FROM sess")
def session_items(spark, sf):
    rows, _ = _session(spark, sf)
    return session.in_reading_order(rows).select("item_id", "notice_id", "subject", "relevance", "item_no", "excluded")


_SESSION_VIEW = f"""{_SESSION}, best AS (SELECT item_id, min(unit_award) AS b FROM award WHERE unit_award > 0 GROUP BY item_id),
obs AS (SELECT s.platform, coalesce(b, s.estimate) AS value, 'ncm:' || code || ':' || CASE unit WHEN 'un' THEN 'pc' ELSE unit END AS key
  FROM sess s LEFT JOIN best USING (item_id) WHERE NOT excluded),
st AS ({stats_sql('obs', 'key, platform', 'value')}), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY mean, platform) AS INTEGER) AS rank,
  max(mean) OVER (PARTITION BY key) AS hi, count(*) OVER (PARTITION BY key) AS n FROM st)"""


def _item_view(spark, sf):
    best = best_awards(award_rows(spark, sf)).select("item_id", "best_award")
    return session.session_item_view(_session(spark, sf)[0].filter("NOT excluded").join(best, "item_id", "left"))


@query(
    "D25_session_item_view",
    f"WITH {_SESSION_VIEW} SELECT key, platform, rank, mean, median, total, cv, {r('(1 - mean / hi) * 100', 1)} AS saving FROM rk WHERE n >= 2",
)
def session_item_view(spark, sf):
    return _item_view(spark, sf).select("key", "platform", "rank", "mean", "median", "total", "cv", "saving")


_NOTICE_VIEW = f"""{_SESSION}, won AS (SELECT item_id, sum(unit_award) AS w FROM award WHERE unit_award > 0 GROUP BY item_id),
nv AS (SELECT notice_id, count(*) AS items, {rsum('estimate')} AS sum_unit_estimates, coalesce({rsum('w')}, 0) AS sum_unit_awards,
  min(municipality || '/' || state) AS place, min(subject) AS subject FROM sess LEFT JOIN won USING (item_id) GROUP BY notice_id),
nvs AS (SELECT *, CASE WHEN sum_unit_estimates > 0 AND sum_unit_awards > 0 THEN {r('(1 - sum_unit_awards / sum_unit_estimates) * 100', 1)} END AS saving FROM nv)"""


def _notice_view(spark, sf):
    return session.session_notice_view(_session(spark, sf)[0], award_rows(spark, sf))


@query("D26_session_notice_view", f"WITH {_NOTICE_VIEW} SELECT notice_id, items, sum_unit_estimates, sum_unit_awards, place, saving FROM nvs")
def session_notice_view(spark, sf):
    return _notice_view(spark, sf).select("notice_id", "items", "sum_unit_estimates", "sum_unit_awards", "place", "saving")


@query(
    "D27_session_counts",
    f"WITH {NOTICE_SQL} SELECT count(*) AS total, count(*) FILTER (modality_id = 3) AS excluded, count(*) FILTER (modality_id <> 3) AS selected FROM notice",
)
def session_counts(spark, sf):
    _, chosen = _session(spark, sf)
    return session.session_counts(notices(spark, sf), chosen)


@query(
    "D33_insight_rows",
    f"""WITH {_SESSION_VIEW}, g AS (SELECT key, arg_min(platform, rank) AS best_platform, min(mean) AS best_price, max(mean) AS dearest, count(*) AS platforms, CAST(sum(total_raw) AS BIGINT) AS obs
  FROM rk WHERE n >= 2 GROUP BY key)
SELECT key, best_platform, best_price, CASE WHEN (dearest - best_price) / greatest(best_price, 1) * 100 > 10
  THEN 'Diferença de ' || CAST(round((dearest - best_price) / greatest(best_price, 1) * 100, 0) AS BIGINT) || '% entre plataformas.' ELSE 'Preços convergentes.' END AS advice
FROM g""",
)
def insight_rows(spark, sf):
    return session.item_insights(_item_view(spark, sf)).select("key", "best_platform", "best_price", "advice")


@query(
    "D33_notice_insights",
    f"""WITH {_NOTICE_VIEW} SELECT notice_id, CASE WHEN saving > 0 THEN 'Economia de ' || printf('%.1f', saving) || '%.' ELSE 'Sem dados de homologação.' END AS analysis,
  CASE WHEN saving > 15 THEN 'Boa margem para proposta competitiva.' END AS chance, CASE WHEN saving < 0 THEN 'Valor homologado acima do estimado.' END AS risk FROM nvs""",
)
def notice_insights(spark, sf):
    return session.notice_insights(_notice_view(spark, sf)).select("notice_id", "analysis", "chance", "risk")


@query(
    "D33_session_summary",
    f"""WITH {_NOTICE_VIEW} SELECT count(*) AS notices, {r('avg(saving) FILTER (saving > 0)', 1)} AS mean_saving FROM nvs""",
)
def session_summary(spark, sf):
    rows = session.shared_items(_session(spark, sf)[0], best_awards(award_rows(spark, sf)), described=False)
    views = session.session_item_view(rows.filter("NOT excluded")), session.session_notice_view(rows)
    return session.session_summary(*views).select("notices", "mean_saving")


# ---------------------------------------------------------------- dossiers


def _analyses(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("notice_id"), "text", F.when(F.col("n_chars") > 5000, "alto").otherwise("baixo").alias("risk_level")
    )


@query(
    "J19_notice_dossier",
    f"""WITH {NOTICE_SQL}, {_BASE}, n_items AS (SELECT notice_id, count(*) AS items, min(description) FILTER (rn = 1) AS first_item FROM (
    SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY item_no, part_id, supplier_id) AS rn FROM item) GROUP BY notice_id)
SELECT n.notice_id, d.doc_id IS NOT NULL AS has_analysis, length(d.text) AS text_length,
  CAST(coalesce(items, 0) AS INTEGER) AS items, first_item, i.p_retailprice AS price FROM notice n LEFT JOIN documents d ON d.doc_id = n.notice_id LEFT JOIN n_items USING (notice_id)
  LEFT JOIN part i ON i.p_partkey = n.notice_id""",
)
def notice_dossier(spark, sf):
    prices = table(spark, sf, "part").select(F.col("p_partkey").alias("notice_id"), F.col("p_retailprice").alias("mean"))
    rows = items(spark, sf)
    boards = rows.groupBy(F.col("state").alias("level"), "platform").agg(
        F.count(F.lit(1)).alias("items"), F.count("award").alias("wins"), F.avg("estimate").alias("mean_discount"),
        F.sum("quantity").alias("weighted_wins"),
    )
    full = dossier.notice_dossier(
        notices(spark, sf), items(spark, sf, with_state=False), _analyses(spark, sf), prices, boards, ["item_no", "part_id", "supplier_id"]
    )
    return full.select(
        "notice_id", F.col("analysis").isNotNull().alias("has_analysis"), F.length("analysis.text").cast("long").alias("text_length"),
        F.coalesce(F.size("items"), F.lit(0)).alias("items"), F.get("items", F.lit(0))["description"].alias("first_item"),
        F.col("reference_price.mean").alias("price"),
    )


@query(
    "J21_market_detail",
    _groups_dedup(_GROUPS_SELECT.replace("SELECT g.level, g.key, g.n_platforms", "SELECT * FROM (SELECT g.level, g.key, g.n_platforms"))
    .replace("SELECT * FROM (SELECT g.level", "SELECT level, key, score, cheapest_platform FROM (SELECT g.level")
    + ") WHERE level = 'NATION_3'",
)
def market_detail(spark, sf):
    found = market.compare_market(items(spark, sf))
    _, groups = dossier.market_detail(found.platforms, found.groups, "NATION_3")
    return groups.select("level", "key", "score", "cheapest_platform")


@query(
    "J22_analyzed_status",
    f"""WITH {NOTICE_SQL} SELECT notice_id, doc_id IS NOT NULL AS analyzed, CASE WHEN doc_id IS NULL THEN 'Edital ainda não foi analisado.' END AS message,
  CASE WHEN n_chars > 5000 THEN 'alto' WHEN doc_id IS NOT NULL THEN 'baixo' END AS risk_level FROM notice LEFT JOIN documents ON doc_id = notice_id""",
)
def analyzed_status(spark, sf):
    rows = dossier.analyzed_status(notices(spark, sf), _analyses(spark, sf))
    return rows.select("notice_id", "analyzed", "message", "risk_level")
