"""Prospecting over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.checks.q_pricing import priced_items, priced_notices
from bidscope.checks.q_documents import tender_docs
from bidscope.checks.q_sources import payload_rows
from bidscope.checks.registry import ORACLES, query
from bidscope.checks.star import AS_OF, MUNICIPALITY_SQL, NOTICE_SQL, PLAIN_ITEM_SQL, as_of, municipalities, notices, r, table
from bidscope.checks.q_joins import item_rows
from bidscope.checks import q_market  # noqa: F401  registers SQL that R6 is made of
from bidscope.functions.scores import round_to
from bidscope.plans import insight, prospect
from bidscope.plans.daily import daily_run
from bidscope.sources import payloads

DAYS = 2000
KEYWORDS = [["Machinery", "red", "Úrgent"], ["widget", "BUILDING"], ["situação O", "gizmo"], ["small", "low"], ["FURNITURE", "high", "bolt"]]
EXCLUSIONS = [["household"], [], ["low machinery"], ["automobile urgent"], []]
HIGH = [["urgent"], ["widget"], ["gizmo"], [], ["high"]]
MEDIUM = [["red"], ["building"], [], ["small"], ["bolt"]]
TARGETS = [["ECO"], ["SMALL", "X"], [], ["PROMO", "STAND"], ["ME"]]


def _pick(values):
    rows = F.array(*[F.array(*map(F.lit, v)).cast("array<string>") for v in values])
    return F.element_at(rows, F.col("org_id") + 1)


def org_configs(spark, sf):
    """One organisation per region, working in the region's nations."""
    base = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("org_id")).agg(F.array_sort(F.collect_set("n_name")).alias("states"))
    return base.select(
        "org_id", "states", F.lit(150000).alias("max_population"), _pick(KEYWORDS).alias("keywords"), F.array(F.lit(6), F.lit(8)).alias("modalities"),
        _pick(HIGH).alias("high_terms"), _pick(MEDIUM).alias("medium_terms"), _pick(EXCLUSIONS).alias("exclusions"),
        F.when(F.col("org_id") == 3, F.array(F.lit(3), F.lit(8), F.lit(13))).otherwise(F.array().cast("array<int>")).alias("microregions"),
        _pick(TARGETS).alias("target_codes"), F.array(F.lit("PNCP")).alias("sources"),
    )


def _items(spark, sf):
    return item_rows(spark, sf).withColumn("total_estimate", F.col("estimate"))


def _rows_sql(name: str, values) -> str:
    rows = [f"({org}, {i}, '{term}')" for org, terms in enumerate(values) for i, term in enumerate(terms)]
    return f"{name}(org_id, position, term) AS (VALUES {', '.join(rows)})"


_PROSPECT = f"""{NOTICE_SQL}, {MUNICIPALITY_SQL}, {PLAIN_ITEM_SQL}, {_rows_sql('kw0', KEYWORDS)}, {_rows_sql('ex', EXCLUSIONS)}, {_rows_sql('hi', HIGH)}, {_rows_sql('md', MEDIUM)}, {_rows_sql('tg', TARGETS)},
kw AS (SELECT *, lower(strip_accents(term)) AS k FROM kw0),
kwf AS (SELECT kw.*, EXISTS (SELECT 1 FROM hi WHERE hi.org_id = kw.org_id AND contains(k, hi.term)) AS is_high, EXISTS (SELECT 1 FROM md WHERE md.org_id = kw.org_id AND contains(k, md.term)) AS is_medium FROM kw),
norm AS (SELECT n.*, m.region_id AS org_id, lower(strip_accents(subject)) AS s, lower(strip_accents(extra_info)) AS x FROM notice n JOIN municipality m USING (municipality_id)
  WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY AND m.population <= 150000 AND (m.region_id <> 3 OR m.microregion_id IN (3, 8, 13))),
cand AS (SELECT * FROM norm WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.org_id = norm.org_id AND contains(s || ' ' || x, ex.term))),
hits AS (SELECT c.org_id, c.notice_id, kwf.term, position, is_high, is_medium, 0 AS f, -1 AS item_no, NULL AS item_id FROM cand c JOIN kwf ON kwf.org_id = c.org_id AND contains(s, k)
  UNION ALL SELECT c.org_id, c.notice_id, kwf.term, position, is_high, is_medium, 1, -1, NULL FROM cand c JOIN kwf ON kwf.org_id = c.org_id AND contains(x, k)
  UNION ALL SELECT c.org_id, c.notice_id, kwf.term, position, is_high, is_medium, 2, item_no, item_no || '-' || part_id || '-' || supplier_id
    FROM cand c JOIN item i ON i.notice_id = c.notice_id JOIN kwf ON kwf.org_id = c.org_id AND contains(description, k)),
term AS (SELECT org_id, notice_id, term, min(f) AS f, min(item_no) AS i, min(position) AS p FROM hits GROUP BY ALL),
agg AS (SELECT org_id, notice_id, count(DISTINCT CASE WHEN f = 0 THEN term END) AS sh, count(DISTINCT CASE WHEN f = 1 THEN term END) AS xh, count(DISTINCT item_id) AS ri,
  max(is_high) AS high, max(is_medium) AS medium FROM hits GROUP BY ALL),
val AS (SELECT org_id, notice_id, sum(estimate) AS v FROM (SELECT DISTINCT h.org_id, h.notice_id, h.item_id, i.estimate FROM hits h JOIN item i ON i.notice_id = h.notice_id
  AND h.item_id = i.item_no || '-' || part_id || '-' || supplier_id) GROUP BY ALL),
code AS (SELECT DISTINCT c.org_id, c.notice_id FROM cand c JOIN item i ON i.notice_id = c.notice_id JOIN tg ON tg.org_id = c.org_id AND starts_with(i.code, tg.term)),
tot AS (SELECT notice_id, count(*) AS n FROM item GROUP BY notice_id),
opp0 AS (SELECT a.*, c.small_business, c.closes_at, (SELECT count(*) FROM kw WHERE kw.org_id = a.org_id) AS kc, code.org_id IS NOT NULL AS has_code, coalesce(n, 0) AS total_items, coalesce(v, 0.0) AS relevant_value,
  (SELECT string_agg(term, ',' ORDER BY f, i, p, term) FROM term t WHERE t.org_id = a.org_id AND t.notice_id = a.notice_id) AS terms_found
  FROM agg a JOIN cand c ON c.org_id = a.org_id AND c.notice_id = a.notice_id LEFT JOIN code ON code.org_id = a.org_id AND code.notice_id = a.notice_id
  LEFT JOIN tot ON tot.notice_id = a.notice_id LEFT JOIN val ON val.org_id = a.org_id AND val.notice_id = a.notice_id),
opp1 AS (SELECT *, {r('''least((CASE WHEN sh > 0 THEN 25 * least(sh / greatest(kc, 1) * 3, 1.0) ELSE 0 END) + (CASE WHEN xh > 0 THEN 10 ELSE 0 END) + (CASE WHEN ri > 0 THEN 20 ELSE 0 END)
  + (CASE WHEN high THEN 20 WHEN medium THEN 10 ELSE 0 END) + (CASE WHEN has_code THEN 10 ELSE 0 END), 100.0)''', 1)} AS base FROM opp0),
opp AS (SELECT *, CASE WHEN small_business THEN least(base + 5, 100.0) ELSE base END AS score FROM opp1)"""


def _found(spark, sf):
    return prospect.prospect(notices(spark, sf), _items(spark, sf), municipalities(spark, sf), org_configs(spark, sf), as_of(), DAYS)


@query(
    "J13_org_notice_match",
    f"WITH {_PROSPECT} SELECT org_id, notice_id, terms_found FROM opp",
)
def org_notice_match(spark, sf):
    return _found(spark, sf).opportunities.select("org_id", "notice_id", F.array_join("terms_found", ",").alias("terms_found"))


_DAYS_SQL = f"floor((epoch(closes_at) - epoch(TIMESTAMP '{AS_OF}')) / 86400)"


@query(
    "R3_prospect_org",
    f"""WITH {_PROSPECT} SELECT org_id, notice_id, score, CASE WHEN score >= 65 THEN 'ALTA' WHEN score >= 35 THEN 'MEDIA' ELSE 'BAIXA' END AS relevance,
  CASE WHEN {_DAYS_SQL} <= 3 THEN 'URGENTE' WHEN {_DAYS_SQL} <= 7 THEN 'PROXIMA' ELSE 'NORMAL' END AS urgency, terms_found,
  concat_ws(',', CASE WHEN sh > 0 THEN 'objeto' END, CASE WHEN xh > 0 THEN 'complementar' END, CASE WHEN ri > 0 OR has_code THEN 'itens' END) AS fields_matched,
  total_items, ri AS relevant_items, {r('relevant_value')} AS relevant_value FROM opp""",
)
def prospect_org(spark, sf):
    rows = _found(spark, sf).opportunities
    return rows.withColumns({
        "terms_found": F.array_join("terms_found", ","), "fields_matched": F.array_join("fields_matched", ","),
        "relevant_value": round_to(F.col("relevant_value")),
    })


@query(
    "R4_prospect_all_orgs",
    f"""WITH {_PROSPECT} SELECT org_id, count(*) AS total, count(*) FILTER (score >= 65) AS high, count(*) FILTER (score >= 35 AND score < 65) AS medium,
  count(*) FILTER (score < 35) AS low FROM opp GROUP BY org_id""",
)
def prospect_all_orgs(spark, sf):
    return insight.org_prospect_stats(_found(spark, sf).opportunities)


@query(
    "R3_matched_items",
    f"WITH {_PROSPECT} SELECT DISTINCT org_id, notice_id, notice_id || '-' || item_id AS item_id FROM hits WHERE item_id IS NOT NULL",
)
def matched_items(spark, sf):
    return _found(spark, sf).items.select("org_id", "notice_id", "item_id")


@query(
    "R5_reprospect_changed",
    f"""WITH {_PROSPECT} SELECT org_id, notice_id, score FROM opp WHERE org_id IN (1, 4)
UNION ALL SELECT n_regionkey, notice_id, -1.0 FROM notice JOIN nation ON n_name = state WHERE n_regionkey NOT IN (1, 4)""",
)
def reprospect_changed(spark, sf):
    new = org_configs(spark, sf)
    changed = F.col("org_id").isin(1, 4)
    old = new.withColumn("max_population", F.when(changed, 5).otherwise(F.col("max_population")))
    region = table(spark, sf, "nation").select(F.col("n_name").alias("state"), F.col("n_regionkey").alias("org_id"))
    found = prospect.prospect(notices(spark, sf), _items(spark, sf), municipalities(spark, sf), new.limit(0), as_of(), DAYS).opportunities
    stored = notices(spark, sf).join(region, "state").select("org_id", "notice_id", F.lit(-1.0).alias("score"))
    stored = found.limit(0).unionByName(stored, allowMissingColumns=True)
    rows = prospect.reprospect_changed(
        stored, old, new, notices(spark, sf), _items(spark, sf), municipalities(spark, sf), as_of(), DAYS
    )
    return rows.select("org_id", "notice_id", "score")


def _payloads(spark, sf):
    return payloads.parse_payloads(payload_rows(spark, sf), "body")


def _targets(spark, sf):
    rows = municipalities(spark, sf).filter("population <= 91692")
    return rows.select("ibge_code", F.col("name").alias("municipality"), "state")


_OPEN = f"""{NOTICE_SQL}, {MUNICIPALITY_SQL}, area AS (SELECT n.*, m.population FROM notice n JOIN municipality m USING (municipality_id)),
kept AS (SELECT * FROM area WHERE closes_at >= TIMESTAMP '{AS_OF}' AND population <= 91692)"""


@query(
    "R1_collect_notices",
    f"WITH {_OPEN} SELECT notice_id, municipality, subject, org_tax_id || '_' || year || '_' || sequence AS natural_key FROM kept",
)
def collect_notices(spark, sf):
    rows = prospect.collect_notices(_payloads(spark, sf), _targets(spark, sf), as_of(), ["notice_id"])
    return rows.select("notice_id", "municipality", "subject", "natural_key")


@query(
    "R1_collection_drops",
    f"""WITH {_OPEN} SELECT state, count(*) AS seen, count(*) FILTER (closes_at < TIMESTAMP '{AS_OF}') AS closed,
  count(*) FILTER (closes_at >= TIMESTAMP '{AS_OF}' AND population > 91692) AS outside, count(*) FILTER (closes_at >= TIMESTAMP '{AS_OF}' AND population <= 91692) AS kept FROM area GROUP BY state""",
)
def collection_drops(spark, sf):
    return prospect.collection_drops(_payloads(spark, sf), _targets(spark, sf), as_of())


_R2_SCORE = f"""least(CASE WHEN len(sm) > 0 THEN 30 * least(len(sm) / 3 * 3, 1.0) ELSE 0 END
  + CASE WHEN contains(s, 'urgent') THEN 25 WHEN contains(s, 'medium') THEN 10 ELSE 0 END
  + CASE WHEN estimate BETWEEN 5000 AND 2000000 THEN 10 WHEN estimate > 0 THEN 5 ELSE 0 END + CASE WHEN modality_id IN (1, 2, 3) THEN 10 ELSE 0 END, 100.0)"""


@query(
    "R2_generic_search",
    f"""WITH {_OPEN.replace(f"closes_at >= TIMESTAMP '{AS_OF}'", "closes_at >= TIMESTAMP '1998-01-01'")}, m AS (SELECT *, lower(subject) AS s, list_filter(['Machinery', 'HIGH', 'build'], lambda k: contains(lower(subject), lower(k))) AS sm FROM kept),
sc AS (SELECT *, {r(_R2_SCORE, 1)} AS score FROM m WHERE len(sm) > 0 AND NOT contains(s, 'high machinery'))
SELECT notice_id, score, CASE WHEN score >= 65 THEN 'ALTA' WHEN score >= 35 THEN 'MEDIA' ELSE 'BAIXA' END AS relevance, array_to_string(sm, ',') AS terms_found FROM sc""",
)
def generic_search(spark, sf):
    rows = prospect.generic_search(
        _payloads(spark, sf), _targets(spark, sf), F.lit("1998-01-01").cast("timestamp"), ["Machinery", "HIGH", "build"],
        ["high machinery"], ["urgent"], ["medium"], keep=["notice_id"],
    )
    return prospect.prospect_order(rows).select("notice_id", "score", "relevance", F.array_join("terms_found", ",").alias("terms_found"))


@query(
    "R6_daily_results",
    f"""SELECT 'document' AS part, CAST(notice_id AS VARCHAR) AS row_key, CAST(risk_score AS DOUBLE) AS value FROM ({ORACLES["T10_doc_risk"]})
UNION ALL SELECT 'market group', level || '|' || key, CAST(score AS DOUBLE) FROM ({ORACLES["D15_market_groups"]})
UNION ALL SELECT 'reference price', CAST(notice_id AS VARCHAR), CAST(reliability AS DOUBLE) FROM ({ORACLES["D9_reference_price"]})""",
)
def daily(spark, sf):
    n = priced_notices(spark, sf)
    goods = priced_items(spark, sf).withColumn("total_estimate", F.col("estimate"))
    results = daily_run(n, goods, tender_docs(spark, sf), municipalities(spark, sf), org_configs(spark, sf), as_of(), DAYS)

    def part(name, table_name, key, value):
        return results[table_name].select(F.lit(name).alias("part"), key.cast("string").alias("row_key"), F.col(value).cast("double").alias("value"))

    return (
        part("document", "document_analysis", F.col("notice_id"), "risk_score")
        .unionByName(part("market group", "market_groups", F.concat_ws("|", "level", "key"), "score"))
        .unionByName(part("reference price", "reference_prices", F.col("notice_id"), "reliability"))
    )
