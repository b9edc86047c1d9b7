"""Column functions over whole tables and whole texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bidscope.checks.registry import query
from bidscope.checks.star import (
    AS_OF, ITEM_SQL, MUNICIPALITY_SQL, NOTICE_SQL, PLAIN_ITEM_SQL, as_of, index_folder, items, municipalities, notices, r, table,
)
from bidscope.functions import fixed_values as fixed
from bidscope.functions import keys, parsing, scores, text, units
from bidscope.operators import text_index
from bidscope.operators.matching import match_fields

_SOURCE_HASH = "sha256('PNCP:' || org_tax_id || ':' || year || ':' || sequence)[1:32]"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("K1_notice_hash", f"WITH {NOTICE_SQL} SELECT notice_id, {_SOURCE_HASH} AS hash FROM notice")
def notice_hash(spark, sf):
    columns = [F.col(c) for c in ("source", "org_tax_id", "year", "sequence")]
    return notices(spark, sf).select("notice_id", keys.notice_hash(*columns).alias("hash"))


@query(
    "K2_notice_text_hash",
    f"""WITH {NOTICE_SQL} SELECT notice_id, sha256('PORTAL:' || municipality || ':' || subject[1:100] || ':' ||
  strftime(published_at, '%Y-%m-%d'))[1:32] AS hash FROM notice""",
)
def notice_text_hash(spark, sf):
    value = keys.notice_text_hash(
        F.lit("PORTAL"), F.col("municipality"), F.col("subject"), F.col("published_at")
    )
    return notices(spark, sf).select("notice_id", value.alias("hash"))


@query(
    "K3_natural_key",
    f"""WITH {NOTICE_SQL} SELECT notice_id, org_tax_id || '_' || year || '_' ||
  CASE WHEN status = 'P' THEN '' ELSE CAST(sequence AS VARCHAR) END AS natural_key FROM notice""",
)
def natural_key(spark, sf):
    sequence = F.when(F.col("status") != "P", F.col("sequence"))
    return notices(spark, sf).select(
        "notice_id", keys.natural_key(F.col("org_tax_id"), F.col("year"), sequence).alias("natural_key")
    )


_NORM = "lower(strip_accents(text))"


@query("H1_normalize_text", f"SELECT doc_id, length({_NORM}) AS chars, md5({_NORM}) AS digest FROM documents")
def normalize_text(spark, sf):
    norm = text.normalize_text(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(norm).alias("chars"), F.md5(norm).alias("digest")
    )


_SQUEEZED = f"trim(regexp_replace({_NORM}, '\\s+', ' ', 'g'))"


@query(
    "H2_normalize_description",
    f"SELECT doc_id, length({_SQUEEZED}) AS chars, md5({_SQUEEZED}) AS digest FROM documents",
)
def normalize_description(spark, sf):
    norm = text.normalize_description(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(norm).alias("chars"), F.md5(norm).alias("digest")
    )


_SYNONYM_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in fixed.SYNONYMS.items())
_TERMS = f"""syn(a, b) AS (VALUES {_SYNONYM_ROWS}),
word AS (SELECT doc_id, unnest(string_split_regex({_NORM}, '\\s+')) AS w FROM documents),
term AS (SELECT DISTINCT doc_id, coalesce(b, w) AS t FROM word LEFT JOIN syn ON a = w
  WHERE regexp_full_match(w, '[a-z0-9]{{2,}}') AND NOT regexp_full_match(w, '[0-9]+')
    AND NOT list_contains({sql_list(fixed.STOP_WORDS)}, w))"""


@query(
    "H3_extract_terms",
    f"""WITH {_TERMS}, l AS (SELECT doc_id, string_agg(t, ' ' ORDER BY t) AS s, count(*) AS n FROM term GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS terms, md5(coalesce(s, '')) AS digest FROM documents LEFT JOIN l USING (doc_id)""",
)
def extract_terms(spark, sf):
    terms = text.extract_terms(F.col("text"))
    return (
        table(spark, sf, "documents")
        .select("doc_id", terms.alias("terms"))
        .select("doc_id", F.size("terms").cast("long").alias("terms"), F.md5(F.array_join("terms", " ")).alias("digest"))
    )


@query(
    "H4_apply_synonyms",
    f"""WITH {PLAIN_ITEM_SQL} SELECT DISTINCT description, replace(replace(description, 'red', 'vermelho'), 'bolt', 'parafuso') AS mapped
FROM item""",
)
def apply_synonyms(spark, sf):
    mapping = {"red": "vermelho", "bolt": "parafuso"}
    mapped = text.apply_synonyms(text.words(F.col("description")), mapping)
    rows = items(spark, sf, with_state=False).select("description").distinct()
    return rows.select("description", F.array_join(mapped, " ").alias("mapped"))


@query(
    "H5_lexical_key",
    f"""WITH {_TERMS}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t) AS rn FROM term)
SELECT doc_id, coalesce(k, '') AS lexical_key FROM documents LEFT JOIN (
  SELECT doc_id, string_agg(t, ' ' ORDER BY t) AS k FROM f WHERE rn <= 4 GROUP BY doc_id) USING (doc_id)""",
)
def lexical_key(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.lexical_key(text.extract_terms(F.col("text"))).alias("lexical_key")
    )


_CU = "CASE unit WHEN 'un' THEN 'pc' ELSE unit END"
_LEX = "array_to_string(list_sort(list_distinct(string_split(description, ' '))), ' ')"


@query(
    "H6_group_keys",
    f"""WITH {PLAIN_ITEM_SQL}, k AS (SELECT unnest(['ncm:' || code || ':' || {_CU},
  'ncm4:' || code[1:4] || ':' || {_LEX} || ':' || {_CU}, 'desc:' || {_LEX} || ':' || {_CU}]) AS key FROM item)
SELECT key, count(*) AS items FROM k GROUP BY key""",
)
def group_keys(spark, sf):
    parts = items(spark, sf, with_state=False).select(
        "code",
        text.extract_terms(F.col("description"), max_terms=6).alias("terms"),
        units.canonical_unit(F.col("unit")).alias("cu"),
    )
    key_list = keys.group_keys(F.col("code"), F.col("terms"), F.col("cu"))
    rows = parts.select(F.explode_outer(key_list).alias("key"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("items"))


@query(
    "H7_canonical_unit",
    f"""WITH {PLAIN_ITEM_SQL} SELECT unit, {_CU.replace("ELSE unit", "WHEN 'caixa' THEN 'caixa' ELSE unit")} AS canonical,
  count(*) AS items FROM item GROUP BY ALL""",
)
def canonical_unit(spark, sf):
    rows = items(spark, sf, with_state=False)
    return rows.groupBy("unit", units.canonical_unit(F.col("unit")).alias("canonical")).agg(
        F.count(F.lit(1)).alias("items")
    )


@query(
    "H8_units_compatible",
    f"""WITH {PLAIN_ITEM_SQL}, o AS (SELECT unit, CASE item_no % 4 WHEN 0 THEN '' WHEN 1 THEN 'Unidade' WHEN 2 THEN 'QUILO' ELSE 'cx' END AS other FROM item)
SELECT unit, other, other = '' OR (unit, other) IN (('un', 'Unidade'), ('kg', 'QUILO'), ('caixa', 'cx')) AS compatible,
  count(*) AS items FROM o GROUP BY ALL""",
)
def units_compatible(spark, sf):
    kind = F.col("item_no") % 4
    other = F.when(kind == 0, "").when(kind == 1, "Unidade").when(kind == 2, "QUILO").otherwise("cx")
    rows = items(spark, sf, with_state=False).select("unit", other.alias("other"))
    return rows.groupBy(
        "unit", "other", units.units_compatible(F.col("unit"), F.col("other")).alias("compatible")
    ).agg(F.count(F.lit(1)).alias("items"))


_WORDED_SQL = f"""{PLAIN_ITEM_SQL}, worded AS (SELECT *, CASE platform_id WHEN 0 THEN 'Serviço de ' WHEN 1 THEN 'Licença de software '
  WHEN 2 THEN 'Papel ' WHEN 3 THEN 'Manutenção e software ' WHEN 4 THEN 'Notebook e servidor ' ELSE '' END || description AS txt FROM item)"""


def _worded(spark, sf):
    kind = F.col("platform_id")
    prefix = (
        F.when(kind == 0, "Serviço de ").when(kind == 1, "Licença de software ").when(kind == 2, "Papel ")
        .when(kind == 3, "Manutenção e software ").when(kind == 4, "Notebook e servidor ").otherwise("")
    )
    return items(spark, sf, with_state=False).withColumn("txt", F.concat(prefix, F.col("description")))


@query(
    "H9_item_category",
    f"""WITH {_WORDED_SQL} SELECT txt, CASE platform_id WHEN 0 THEN 'servico' WHEN 1 THEN 'licenca' WHEN 2 THEN 'consumivel'
  WHEN 3 THEN 'servico' ELSE 'produto' END AS category, count(*) AS items FROM worded GROUP BY ALL""",
)
def item_category(spark, sf):
    rows = _worded(spark, sf).withColumn("category", text.item_category(text.normalize_text(F.col("txt"))))
    return rows.groupBy("txt", "category").agg(F.count(F.lit(1)).alias("items"))


@query(
    "H10_categories_compatible",
    f"""WITH {_WORDED_SQL}, c AS (SELECT CASE platform_id WHEN 0 THEN 'servico' WHEN 1 THEN 'licenca' WHEN 2 THEN 'consumivel'
  WHEN 3 THEN 'servico' ELSE 'produto' END AS a, CASE item_no % 4 WHEN 0 THEN 'servico' WHEN 1 THEN 'licenca'
  WHEN 2 THEN 'consumivel' ELSE 'produto' END AS b FROM worded)
SELECT a, b, NOT (a || b IN ('servicoproduto', 'produtoservico', 'servicoconsumivel', 'consumivelservico',
  'licencaconsumivel', 'consumivellicenca', 'licencaproduto', 'produtolicenca')) AS compatible, count(*) AS items FROM c GROUP BY ALL""",
)
def categories_compatible(spark, sf):
    kind = F.col("item_no") % 4
    other = F.when(kind == 0, "servico").when(kind == 1, "licenca").when(kind == 2, "consumivel").otherwise("produto")
    rows = _worded(spark, sf).select(
        text.item_category(text.normalize_text(F.col("txt"))).alias("a"), other.alias("b")
    )
    return rows.groupBy("a", "b", units.categories_compatible(F.col("a"), F.col("b")).alias("compatible")).agg(
        F.count(F.lit(1)).alias("items")
    )


@query(
    "H11_material_or_service",
    f"""WITH {_WORDED_SQL} SELECT txt, CASE WHEN platform_id IN (0, 1, 3) THEN 'S' WHEN platform_id = 4 THEN 'M' END AS kind,
  count(*) AS items FROM worded GROUP BY ALL""",
)
def material_or_service(spark, sf):
    rows = _worded(spark, sf).withColumn("kind", text.material_or_service(text.normalize_text(F.col("txt"))))
    return rows.groupBy("txt", "kind").agg(F.count(F.lit(1)).alias("items"))


_D = "(estimate - best_award) / estimate * 100"


@query(
    "H12_select_price",
    f"""WITH {PLAIN_ITEM_SQL} SELECT notice_id, item_no, part_id, supplier_id,
  {r('CASE WHEN best_award > 0 THEN best_award ELSE estimate END')} AS value,
  CASE WHEN best_award > 0 THEN 'awarded' ELSE 'estimated' END AS price_source,
  CASE WHEN {_D} BETWEEN 0 AND 80 THEN {r(_D)} END AS discount FROM item""",
)
def select_price(spark, sf):
    # the smallest positive of the awards wins; a zero award never counts
    awards = F.array(F.col("award"), F.col("award") * 2, F.lit(0.0))
    price = scores.select_price(F.array_compact(awards), F.col("estimate"))
    rows = items(spark, sf, with_state=False).select("*", price.alias("p"))
    return rows.select(
        "notice_id", "item_no", "part_id", "supplier_id",
        scores.round_to(F.col("p.value")).alias("value"), "p.price_source", "p.discount",
    )


@query(
    "H13_real_discount",
    f"""WITH {PLAIN_ITEM_SQL}, d AS (SELECT estimate, quantity * 1000 AS award FROM item)
SELECT estimate, award, CASE WHEN estimate > 0 AND award > 0 AND (estimate - award) / estimate * 100 BETWEEN 0 AND 80
  THEN {r('(estimate - award) / estimate * 100')} END AS discount FROM d""",
)
def real_discount(spark, sf):
    award = F.col("quantity") * 1000
    return items(spark, sf, with_state=False).select(
        "estimate", award.alias("award"), scores.real_discount(F.col("estimate"), award).alias("discount")
    )


_FPM = " ".join(f"WHEN population <= {p} THEN {c}" for p, c in fixed.FPM_STEPS)
_LIMIT = " ".join(f"WHEN coefficient <= {c} THEN {p}" for p, c in fixed.FPM_STEPS)


@query(
    "H14_fpm_coefficient",
    f"""WITH {MUNICIPALITY_SQL}, m AS (SELECT municipality_id, population,
  CAST(CASE {_FPM} ELSE 4.0 END AS DOUBLE) AS coefficient FROM municipality)
SELECT *, CASE {_LIMIT} ELSE 999999 END AS population_limit FROM m""",
)
def fpm_coefficient(spark, sf):
    return municipalities(spark, sf).select(
        "municipality_id", "population", parsing.fpm_coefficient(F.col("population")).alias("coefficient")
    ).withColumn("population_limit", parsing.population_limit(F.col("coefficient")))


_PER_ORDER = """o AS (SELECT l_orderkey, count(*) AS n, avg(l_discount) * 10 AS share,
  stddev_samp(l_extendedprice) / avg(l_extendedprice) * 100 AS cv, avg(l_tax) * 1000 AS days, avg(l_quantity) * 2 AS sim
  FROM lineitem GROUP BY l_orderkey)"""


@query(
    "H15_ratios",
    f"""WITH {_PER_ORDER} SELECT l_orderkey,
  {r('CASE WHEN n >= 10 THEN 1.0 WHEN n >= 3 THEN 0.5 + 0.5 * (n - 3) / 7 ELSE 0.5 * n / 3 END', 4)} AS sample,
  {r('CASE WHEN days <= 90 THEN 1.0 WHEN days <= 180 THEN 1 - 0.5 * (days - 90) / 90 WHEN days <= 365 THEN 0.5 - 0.5 * (days - 180) / 185 ELSE 0 END', 4)} AS recency,
  {r('CASE WHEN cv IS NULL THEN 0 WHEN cv <= 10 THEN 1.0 WHEN cv <= 25 THEN 1 - 0.5 * (cv - 10) / 15 WHEN cv <= 50 THEN 0.5 - 0.5 * (cv - 25) / 25 ELSE 0 END', 4)} AS dispersion,
  {r('CASE WHEN cv IS NULL THEN 0.5 WHEN cv <= 10 THEN 1.0 WHEN cv <= 25 THEN 1 - 0.5 * (cv - 10) / 15 WHEN cv <= 50 THEN 0.5 - 0.5 * (cv - 25) / 25 ELSE 0 END', 4)} AS dispersion_neutral,
  {r('CASE WHEN share >= 0.8 THEN share ELSE greatest(0.2, share) END', 4)} AS awarded,
  {r('CASE WHEN share >= 1 THEN 1.0 WHEN share >= 0.8 THEN 0.9 WHEN share >= 0.5 THEN 0.5 + 0.4 * (share - 0.5) / 0.3 WHEN share > 0 THEN 0.2 + 0.3 * share / 0.5 ELSE 0.2 END', 4)} AS awarded_stepped,
  {r('CASE WHEN sim >= 70 THEN 1.0 WHEN sim >= 50 THEN 0.5 + 0.5 * (sim - 50) / 20 ELSE greatest(0, sim / 100) END', 4)} AS similarity
FROM o""",
)
def ratios(spark, sf):
    price = F.col("l_extendedprice")
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg("l_discount") * 10).alias("share"),
        (F.stddev_samp(price) / F.avg(price) * 100).alias("cv"),
        (F.avg("l_tax") * 1000).alias("days"),
        (F.avg("l_quantity") * 2).alias("sim"),
    )
    ratio = {
        "sample": scores.sample_ratio(F.col("n")),
        "recency": scores.recency_ratio(F.col("days")),
        "dispersion": scores.dispersion_ratio(F.col("cv")),
        "dispersion_neutral": scores.dispersion_ratio_neutral(F.col("cv")),
        "awarded": scores.awarded_ratio(F.col("share")),
        "awarded_stepped": scores.awarded_ratio_stepped(F.col("share")),
        "similarity": scores.similarity_ratio(F.col("sim")),
    }
    return per_order.select("l_orderkey", *[scores.round_to(c, 4).alias(n) for n, c in ratio.items()])


_REL = """sample AS (SELECT *, 25 * CASE WHEN n >= 10 THEN 1.0 WHEN n >= 3 THEN 0.5 + 0.5 * (n - 3) / 7 ELSE 0.5 * n / 3 END AS f1,
  20 * CASE WHEN days <= 90 THEN 1.0 WHEN days <= 180 THEN 1 - 0.5 * (days - 90) / 90 WHEN days <= 365 THEN 0.5 - 0.5 * (days - 180) / 185 ELSE 0 END AS f2,
  20 * CASE WHEN share >= 0.8 THEN share ELSE greatest(0.2, share) END AS f3,
  20 * CASE WHEN cv IS NULL THEN 0 WHEN cv <= 10 THEN 1.0 WHEN cv <= 25 THEN 1 - 0.5 * (cv - 10) / 15 WHEN cv <= 50 THEN 0.5 - 0.5 * (cv - 25) / 25 ELSE 0 END AS f4,
  15 * CASE WHEN sim >= 70 THEN 1.0 WHEN sim >= 50 THEN 0.5 + 0.5 * (sim - 50) / 20 ELSE greatest(0, sim / 100) END AS f5 FROM o)"""


@query(
    "D10_reliability_score",
    f"""WITH {_PER_ORDER}, {_REL}, t AS (SELECT l_orderkey, n, {r('f1', 1)} AS sample, {r('f2', 1)} AS recency, {r('f3', 1)} AS awarded,
  {r('f4', 1)} AS dispersion, {r('f5', 1)} AS similarity FROM sample),
s AS (SELECT *, {r('sample + recency + awarded + dispersion + similarity', 1)} AS score FROM t)
SELECT * EXCLUDE (n), CASE WHEN n < 3 THEN 'insuficiente' WHEN score >= 70 THEN 'alta' WHEN score >= 40 THEN 'media' ELSE 'baixa' END AS band FROM s""",
)
def reliability(spark, sf):
    price = F.col("l_extendedprice")
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg("l_discount") * 10).alias("share"),
        (F.stddev_samp(price) / F.avg(price) * 100).alias("cv"),
        (F.avg("l_tax") * 1000).alias("days"),
        (F.avg("l_quantity") * 2).alias("sim"),
    )
    score = scores.reliability(*[F.col(c) for c in ("n", "cv", "share", "days", "sim")])
    return per_order.select("l_orderkey", score.alias("s")).select("l_orderkey", "s.*")


_DAYS = f"floor((epoch(closes_at) - epoch(TIMESTAMP '{AS_OF}')) / 86400)"


@query(
    "H16_urgency",
    f"""WITH {NOTICE_SQL} SELECT notice_id, CASE WHEN {_DAYS} <= 3 THEN 'URGENTE' WHEN {_DAYS} <= 7 THEN 'PROXIMA'
  ELSE 'NORMAL' END AS urgency FROM notice""",
)
def urgency(spark, sf):
    return notices(spark, sf).select("notice_id", scores.urgency(F.col("closes_at"), as_of()).alias("urgency"))


@query(
    "H17_score_band",
    """SELECT o_orderkey, round(o_totalprice / 5000, 1) AS score, CASE WHEN round(o_totalprice / 5000, 1) >= 65 THEN 'ALTA'
  WHEN round(o_totalprice / 5000, 1) >= 35 THEN 'MEDIA' ELSE 'BAIXA' END AS band FROM orders""",
)
def score_band(spark, sf):
    score = F.round(F.col("o_totalprice") / 5000, 1)
    return table(spark, sf, "orders").select(
        "o_orderkey", score.alias("score"), scores.score_band(score).alias("band")
    )


@query(
    "H18_parse_notice_url",
    f"""WITH {NOTICE_SQL} SELECT notice_id, CASE WHEN status <> 'P' AND sequence <> 0 THEN org_tax_id END AS tax_id,
  CASE WHEN status <> 'P' AND sequence <> 0 THEN year END AS year,
  CASE WHEN status <> 'P' AND sequence <> 0 THEN CAST(sequence AS INTEGER) END AS sequence FROM notice""",
)
def parse_notice_url(spark, sf):
    built = parsing.notice_url(F.col("org_tax_id"), F.col("year"), F.col("sequence"))
    url = F.when(F.col("status") == "P", "https://example.org/other").otherwise(built)
    parsed = parsing.parse_notice_url(url)
    return notices(spark, sf).select("notice_id", parsed.alias("p")).select("notice_id", "p.*")


_PHRASES = "['Pregão Eletrônico', 'tomada de preço', 'CONVITE', 'dispensa de', 'sem modalidade']"


@query(
    "H19_detect_modality",
    f"""WITH {NOTICE_SQL} SELECT notice_id, ['Pregão Eletrônico', 'Tomada de Preços', 'Convite', 'Dispensa de Licitação', ''][modality_id] AS detected
FROM notice""",
)
def detect_modality(spark, sf):
    phrases = F.array(*[F.lit(p) for p in ("PREGÃO ELETRÔNICO", "tomada de preço", "CONVITE", "dispensa de", "sem modalidade")])
    txt = F.concat(F.lit("Edital: "), F.element_at(phrases, F.col("modality_id")), F.lit(" "), F.col("subject"))
    return notices(spark, sf).select("notice_id", parsing.detect_modality(txt).alias("detected"))


@query(
    "H20_parse_br_date",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""",
)
def parse_br_date(spark, sf):
    txt = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "'Publicado em 'dd/MM/yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd/MM/yy"))
        .otherwise(F.date_format("o_orderdate", "dd'/13/'yyyy"))
    )
    return table(spark, sf, "orders").select("o_orderkey", parsing.parse_br_date(txt).alias("iso"))


@query("H21_parse_br_money", "SELECT o_orderkey, o_totalprice AS amount FROM orders")
def parse_br_money(spark, sf):
    shown = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return table(spark, sf, "orders").select(
        "o_orderkey", parsing.parse_br_money(F.concat(F.lit("R$ "), shown)).alias("amount")
    )


@query(
    "H22_process_number",
    f"""WITH {NOTICE_SQL} SELECT notice_id, CASE WHEN status = 'P' THEN '' ELSE (sequence % 1000) || '/' || year END AS process_number FROM notice""",
)
def process_number(spark, sf):
    number = F.concat((F.col("sequence") % 1000).cast("string"), F.lit("/"), F.col("year").cast("string"))
    lead = F.when(F.col("status") == "F", "PROCESSO Nº ").when(F.col("status") == "O", "Pregão: ").otherwise("ref ")
    return notices(spark, sf).select(
        "notice_id", parsing.process_number(F.concat(lead, number)).alias("process_number")
    )


@query(
    "H23_relevance_by_terms",
    f"""WITH {NOTICE_SQL} SELECT notice_id, CASE WHEN lower(subject) LIKE '%machinery%' OR lower(subject) LIKE '%urgent%' THEN 'ALTA'
  WHEN lower(subject) LIKE '%building%' THEN 'MEDIA' ELSE 'BAIXA' END AS relevance FROM notice""",
)
def relevance_by_terms(spark, sf):
    level = text.relevance_by_terms(
        text.normalize_text(F.col("subject")), ["Máchinery", "URGENT"], ["building"]
    )
    return notices(spark, sf).select("notice_id", level.alias("relevance"))


KEYWORDS = ["Machinery", "high", "situacao o", "FURNITURE"]
EXCLUDED = ["household low"]

_MATCH_SQL = f"""{NOTICE_SQL}, norm AS (SELECT *, lower(strip_accents(subject)) AS s, lower(strip_accents(extra_info)) AS x FROM notice),
m AS (SELECT *, contains(s || ' ' || x, 'household low') AS excluded,
  list_filter(['Machinery', 'high', 'situacao o', 'FURNITURE'], lambda k: contains(s, lower(k))) AS sm,
  list_filter(['Machinery', 'high', 'situacao o', 'FURNITURE'], lambda k: contains(x, lower(k))) AS xm FROM norm)"""


@query(
    "P1_keywords_matched",
    f"WITH {_MATCH_SQL} SELECT notice_id, array_to_string(sm, ',') AS matched FROM m",
)
def keywords_matched(spark, sf):
    found = text.keywords_matched(text.normalize_text(F.col("subject")), KEYWORDS)
    return notices(spark, sf).select("notice_id", F.array_join(found, ",").alias("matched"))


@query("P2_exclusion_hit", f"WITH {_MATCH_SQL} SELECT notice_id, excluded FROM m")
def exclusion_hit(spark, sf):
    txt = F.concat_ws(" ", "subject", "extra_info")
    return notices(spark, sf).select(
        "notice_id", text.any_term_in(text.normalize_text(txt), EXCLUDED).alias("excluded")
    )


@query(
    "P3_match_fields",
    f"""WITH {_MATCH_SQL}, u AS (SELECT *, list_concat(sm, list_filter(xm, lambda k: NOT list_contains(sm, k))) AS terms FROM m)
SELECT notice_id, NOT excluded AND len(terms) > 0 AS matched,
  CASE WHEN excluded THEN '' ELSE array_to_string(terms, ',') END AS terms_found,
  CASE WHEN excluded THEN '' WHEN len(sm) > 0 AND len(xm) > 0 THEN 'objeto,complementar' WHEN len(sm) > 0 THEN 'objeto'
    WHEN len(xm) > 0 THEN 'complementar' ELSE '' END AS fields_matched FROM u""",
)
def matched_fields(spark, sf):
    rows = match_fields(notices(spark, sf), "subject", "extra_info", KEYWORDS, EXCLUDED)
    return rows.select(
        "notice_id", "matched", F.array_join("terms_found", ",").alias("terms_found"),
        F.array_join("fields_matched", ",").alias("fields_matched"),
    )


_SCORE_SQL = f"""least(CASE WHEN len(sm) > 0 THEN 30 * least(len(sm) / 4 * 3, 1.0) ELSE 0 END
  + CASE WHEN len(xm) > 0 THEN 15 ELSE 0 END
  + CASE WHEN contains(s || ' ' || x, 'urgent') THEN 25 WHEN contains(s || ' ' || x, 'medium') THEN 10 ELSE 0 END
  + CASE WHEN estimate BETWEEN 5000 AND 2000000 THEN 10 WHEN estimate > 0 THEN 5 ELSE 0 END
  + CASE WHEN modality_id IN (1, 2, 3) THEN 10 ELSE 0 END, 100.0)"""


@query(
    "H24_notice_score",
    f"WITH {_MATCH_SQL} SELECT notice_id, {r(_SCORE_SQL, 1)} AS score FROM m WHERE NOT excluded",
)
def notice_score(spark, sf):
    rows = match_fields(notices(spark, sf), "subject", "extra_info", KEYWORDS, EXCLUDED).filter("not excluded")
    norm = text.normalize_text(F.col("subject"))
    score = scores.notice_score(
        norm, text.normalize_text(F.concat_ws(" ", "subject", "extra_info")),
        F.col("subject_matches"), F.col("extra_matches"), len(KEYWORDS), F.col("estimate"),
        F.col("modality_id"), ["urgent"], ["medium"],
    )
    return rows.select("notice_id", score.alias("score"))


@query(
    "H25_org_score",
    """WITH o AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS hits, count(*) FILTER (l_linestatus = 'F') AS extra,
    count(*) FILTER (l_discount > 0.05) AS item_hits, max(l_tax) >= 0.07 AS high, max(l_tax) >= 0.04 AS medium,
    min(l_quantity) < 5 AS code, min(l_linenumber) = 1 AS small FROM lineitem GROUP BY l_orderkey),
b AS (SELECT *, least(25 * least(hits / 8 * 3, 1.0) + CASE WHEN extra > 0 THEN 10 ELSE 0 END + CASE WHEN item_hits > 0 THEN 20 ELSE 0 END
  + CASE WHEN high THEN 20 WHEN medium THEN 10 ELSE 0 END + CASE WHEN code THEN 10 ELSE 0 END, 100.0) AS base FROM o)
SELECT l_orderkey, CASE WHEN small THEN least(""" + r("base", 1) + """ + 5, 100.0) ELSE """ + r("base", 1) + """ END AS score FROM b""",
)
def org_score(spark, sf):
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.countDistinct("l_returnflag").alias("hits"),
        F.count_if(F.col("l_linestatus") == "F").alias("extra"),
        F.count_if(F.col("l_discount") > 0.05).alias("item_hits"),
        (F.max("l_tax") >= 0.07).alias("high"),
        (F.max("l_tax") >= 0.04).alias("medium"),
        (F.min("l_quantity") < 5).alias("code"),
        (F.min("l_linenumber") == 1).alias("small"),
    )
    score = scores.org_score(
        F.col("hits"), F.lit(8), F.col("extra"), F.col("item_hits"), F.col("high"), F.col("medium"),
        F.col("code"), F.col("small"),
    )
    return o.select("l_orderkey", score.alias("score"))


_PAIRS = f"""{NOTICE_SQL}, first AS (SELECT municipality_id, min(notice_id) AS ref_id FROM notice GROUP BY ALL),
pair AS (SELECT n.notice_id, n.modality = f.modality AS sm, n.state = f.state AS ss, n.subject AS subject, f.subject AS ref_subject,
  floor((epoch(TIMESTAMP '{AS_OF}') - epoch(n.published_at)) / 86400) AS days,
  list_distinct(string_split(lower(n.subject), ' ')) AS t, list_distinct(string_split(lower(f.subject), ' ')) AS rt
  FROM notice n JOIN first USING (municipality_id) JOIN notice f ON f.notice_id = ref_id),
clean AS (SELECT *, list_filter(t, lambda w: regexp_full_match(w, '[a-z0-9]{{2,}}')) AS ct,
  list_filter(rt, lambda w: regexp_full_match(w, '[a-z0-9]{{2,}}')) AS crt FROM pair)"""
_RECENT = "CASE WHEN days <= 180 THEN 10 WHEN days <= 365 THEN 10 * (1 - (days - 180) / 185) ELSE 0 END"
_COMMON = "20 * least(len(list_intersect(ct, crt)) / len(crt), 1.0)"


def _pairs(spark, sf):
    n = notices(spark, sf).select(
        "notice_id", "municipality_id", "modality", "state", "published_at",
        text.extract_terms(F.col("subject")).alias("terms"),
    )
    first = n.groupBy("municipality_id").agg(F.min("notice_id").alias("ref_id"))
    ref = n.select(
        F.col("notice_id").alias("ref_id"), F.col("modality").alias("ref_modality"),
        F.col("state").alias("ref_state"), F.col("terms").alias("ref_terms"),
    )
    days = parsing.floor_days(as_of(), F.col("published_at"))
    return n.join(first, "municipality_id").join(ref, "ref_id").withColumn("days", days)


@query(
    "H26_notice_similarity",
    f"WITH {_PAIRS} SELECT notice_id, {r(f'least(((CASE WHEN sm THEN 20 ELSE 0 END) + (CASE WHEN ss THEN 15 ELSE 0 END) + {_COMMON} + {_RECENT}) * (100 / 65), 100.0)')} AS score FROM clean",
)
def notice_similarity(spark, sf):
    score = scores.notice_similarity(
        F.col("modality") == F.col("ref_modality"), F.col("state") == F.col("ref_state"),
        F.col("terms"), F.col("ref_terms"), F.col("days"),
    )
    return _pairs(spark, sf).select("notice_id", score.alias("score"))


@query(
    "H27_item_similarity",
    f"""WITH {ITEM_SQL}, s AS (SELECT notice_id, item_no, part_id, supplier_id, code, unit, state = 'NATION_3' AS ss, string_split(description, ' ') AS ct,
  floor((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400) AS days, ['red', 'widget', 'small'] AS crt FROM item)
SELECT notice_id, item_no, part_id, supplier_id,
  {r(f'least((12.5 + (CASE WHEN ss THEN 15 ELSE 0 END) + {_COMMON} + 5 + {_RECENT}) * (100 / 65), 100.0)')} AS score FROM s""",
)
def item_similarity(spark, sf):
    score = scores.item_similarity(
        F.col("code"), F.col("state") == "NATION_3", text.extract_terms(F.col("description")),
        F.array(F.lit("red"), F.lit("widget"), F.lit("small")), F.col("unit"),
        parsing.floor_days(as_of(), F.col("created_at")),
    )
    return items(spark, sf).select("notice_id", "item_no", "part_id", "supplier_id", score.alias("score"))


@query(
    "H29_date_windows",
    f"""WITH {NOTICE_SQL}, p AS (SELECT state, CAST(min(published_at) AS DATE) AS a, CAST(max(published_at) AS DATE) AS b FROM notice GROUP BY state),
w AS (SELECT state, b, unnest(generate_series(a, b, INTERVAL 7 DAY)) AS first FROM p)
SELECT state, CAST(first AS DATE) AS first, least(CAST(first + INTERVAL 6 DAY AS DATE), b) AS last FROM w""",
)
def date_windows(spark, sf):
    period = notices(spark, sf).groupBy("state").agg(
        F.min("published_at").cast("date").alias("a"), F.max("published_at").cast("date").alias("b")
    )
    windows = F.explode(parsing.date_windows(F.col("a"), F.col("b"), 7))
    return period.select("state", windows.alias("w")).select("state", "w.*")


@query(
    "H30_resolve_period",
    f"""WITH {NOTICE_SQL} SELECT state, count(*) AS notices FROM notice
WHERE CAST(published_at AS DATE) BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}' GROUP BY state""",
)
def resolved_period(spark, sf):
    first, last = parsing.resolve_period(dt.date.fromisoformat(AS_OF), days_back=90)
    day = F.col("published_at").cast("date")
    return (
        notices(spark, sf).filter(day.between(F.lit(first), F.lit(last)))
        .groupBy("state").agg(F.count(F.lit(1)).alias("notices"))
    )


@query(
    "H31_truncate_label",
    f"WITH {NOTICE_SQL} SELECT notice_id, subject[1:8] AS short, municipality || '/' || state AS place FROM notice",
)
def labels(spark, sf):
    return notices(spark, sf).select(
        "notice_id", F.left("subject", F.lit(8)).alias("short"),
        keys.place_label(F.col("municipality"), F.col("state")).alias("place"),
    )


def trigram_sql(expr: str) -> str:
    """Distinct padded trigrams of a text in SQL."""
    return (
        f"list_distinct(flatten(list_transform(regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}]+'), "
        "lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


@query(
    "H32_trigram_similarity",
    f"""WITH t AS (SELECT p_partkey, {trigram_sql('p_name')} AS a, {trigram_sql("'red widgets'")} AS b FROM part)
SELECT p_partkey, {r('len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))', 4)} AS similarity FROM t""",
)
def trigram_similarity(spark, sf):
    value = text.trigram_similarity(text.trigrams(F.col("p_name")), text.trigrams(F.lit("red widgets")))
    return table(spark, sf, "part").select("p_partkey", scores.round_to(value, 4).alias("similarity"))


@query(
    "H32_similar_texts",
    f"""WITH {ITEM_SQL}, t AS (SELECT DISTINCT description AS d, {trigram_sql('description')} AS a FROM item),
q AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS question, {trigram_sql("p_name || ' ' || lower(p_type)")} AS b FROM part),
s AS (SELECT question, d, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS x FROM q, t)
SELECT question, d AS description, {r('x', 6)} AS similarity FROM s WHERE x >= 0.3""",
)
def similar_texts(spark, sf):
    """All names with their types against the stored index of the items' descriptions."""
    path, described = index_folder(spark, "descriptions"), items(spark, sf).select("description").distinct()
    text_index.write_trigram_index(described, "description", path)
    asked = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("question"))
    found = text_index.similar_texts(spark, path, asked, "question")
    named = described.withColumn("key", text_index.text_key(F.col("description")))
    return found.join(named, "key").select("question", "description", scores.round_to(F.col("similarity"), 6).alias("similarity"))


_TOKENS = f"string_split_regex({_NORM}, '[^a-z0-9]+')"


@query(
    "X1_text_match",
    f"""SELECT doc_id, len(list_intersect(list_distinct({_TOKENS}), ['the', 'with', 'from'])) = 3 AS all_terms,
  len(list_intersect({_TOKENS}, ['der', 'und'])) > 0 AS any_term FROM documents""",
)
def text_match(spark, sf):
    tokens = F.split(text.normalize_text(F.col("text")), "[^a-z0-9]+")
    return table(spark, sf, "documents").select(
        "doc_id",
        text.text_match(tokens, ["the", "with", "from"], "all").alias("all_terms"),
        text.text_match(tokens, ["der", "und"], "any").alias("any_term"),
    )


@query(
    "X1_text_index",
    f"""SELECT doc_id, 'all' AS mode FROM documents WHERE len(list_intersect(list_distinct({_TOKENS}), ['the', 'with', 'from'])) = 3
UNION ALL SELECT doc_id, 'any' FROM documents WHERE len(list_intersect({_TOKENS}, ['der', 'und'])) > 0""",
)
def text_by_index(spark, sf):
    """The same searches answered by a stored index of all words."""
    path, tokens = index_folder(spark, "words"), F.split(text.normalize_text(F.col("text")), "[^a-z0-9]+")
    text_index.write_index(table(spark, sf, "documents"), F.col("doc_id"), tokens, path)
    every = text_index.keys_with_terms(spark, path, ["the", "with", "from"])
    either = text_index.keys_with_terms(spark, path, ["der", "und"], "any")
    return every.withColumn("mode", F.lit("all")).unionByName(either.withColumn("mode", F.lit("any"))).withColumnRenamed("key", "doc_id")


@query("X2_substring_match", f"SELECT doc_id, contains({_NORM}, 'tion d') AS hit FROM documents")
def substring_match(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.substring_match(text.normalize_text(F.col("text")), "TION D").alias("hit")
    )


@query(
    "P4_proposal_closed",
    f"""WITH {NOTICE_SQL} SELECT notice_id, CASE WHEN status = 'P' THEN false ELSE closes_at < TIMESTAMP '{AS_OF}' END AS closed,
  CASE WHEN status = 'P' THEN true ELSE closes_at > TIMESTAMP '{AS_OF}' END AS open FROM notice""",
)
def proposal_closed(spark, sf):
    shown = F.when(F.col("status") == "P", "invalido").otherwise(F.date_format("closes_at", "yyyy-MM-dd'T'HH:mm:ss"))
    end = parsing.parse_timestamp(shown)
    return notices(spark, sf).select(
        "notice_id", parsing.proposal_closed(end, as_of()).alias("closed"), parsing.is_open(end, as_of()).alias("open")
    )


@query(
    "P14_comparable_pair",
    f"""WITH {_WORDED_SQL}, c AS (SELECT w.*, CASE platform_id WHEN 0 THEN 'servico' WHEN 1 THEN 'licenca' WHEN 2 THEN 'consumivel' WHEN 3 THEN 'servico' ELSE 'produto' END AS cat,
  p_retailprice, CASE WHEN award IS NULL THEN 'estimated' ELSE 'awarded' END AS src FROM worded w JOIN part ON p_partkey = part_id),
x AS (SELECT notice_id, item_no, part_id, supplier_id, CASE WHEN src <> 'awarded' THEN 'fontes_diferentes'
  WHEN cat IN ('servico', 'licenca') THEN 'categorias_incompativeis' WHEN unit <> 'un' THEN 'unidades_incompativeis'
  WHEN greatest(estimate, p_retailprice) / least(estimate, p_retailprice) > 20 THEN 'escala_incompativel' END AS reason, cat FROM c)
SELECT notice_id, item_no, part_id, supplier_id, reason IS NULL AS comparable, reason,
  CAST(CASE WHEN reason IS NOT NULL THEN 0.0 WHEN cat = 'produto' THEN 1.0 ELSE 0.8 END AS DOUBLE) AS adjust FROM x""",
)
def comparable_pairs(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), "p_retailprice")
    rows = _worded(spark, sf).join(parts, "part_id")
    pair = F.struct(
        F.when(F.col("award").isNull(), "estimated").otherwise("awarded").alias("price_source"),
        text.item_category(text.normalize_text(F.col("txt"))).alias("category"),
        F.col("unit").alias("unit"), F.col("estimate").alias("value"),
    )
    other = F.struct(
        F.lit("awarded").alias("price_source"), F.lit("produto").alias("category"),
        F.lit("Unidade").alias("unit"), F.col("p_retailprice").alias("value"),
    )
    rows = rows.select("notice_id", "item_no", "part_id", "supplier_id", pair.alias("a"), other.alias("b"))
    return rows.withColumn("c", units.comparable_pair(F.col("a"), F.col("b"))).select(
        "notice_id", "item_no", "part_id", "supplier_id", "c.*"
    )
