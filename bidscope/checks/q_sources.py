"""Sources, ingestion, dimensions and table maintenance over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bidscope.checks.registry import query
from bidscope.checks.star import (
    AS_OF, MUNICIPALITY_SQL, NOTICE_SQL, PLAIN_ITEM_SQL, as_of, items, municipalities, notices, r, rsum, table,
)
from bidscope.functions import fixed_values as fixed
from bidscope.functions.keys import notice_hash
from bidscope.functions.scores import money_sum
from bidscope.operators import tables
from bidscope.session import shared_folder, stage
from bidscope.sources import dims, feeds, payloads


def _scratch(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/bidscope/{name}-{uuid.uuid4().hex}"


def payload_rows(spark, sf):
    """Orders as notice payloads in JSON."""
    n = notices(spark, sf)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    payload = F.struct(
        F.struct(
            F.col("org_tax_id").alias("cnpj"), F.col("municipality").alias("razaoSocial"),
            F.col("municipality_id").cast("string").alias("codigoMunicipioIbge"),
        ).alias("orgaoEntidade"),
        F.struct(
            F.when(F.col("status") != "P", F.col("municipality_id").cast("string")).alias("codigoIbge"),
            F.col("state").alias("ufSigla"),
        ).alias("unidadeOrgao"),
        F.struct(F.col("status_id").alias("codigo"), F.col("status").alias("descricao")).alias("amparoLegal"),
        F.col("year").alias("anoCompra"),
        F.col("sequence").alias("sequencialCompra"),
        F.col("subject").alias("objetoCompra"),
        (F.col("modality_id") + 3).alias("modalidadeId"),
        F.col("status_id").alias("situacaoCompraId"),
        F.col("modality_id").alias("modoDisputaId"),
        F.col("status").alias("situacaoCompraNome"),
        F.col("modality_id").alias("tipoBeneficioId"),
        F.col("estimate").alias("valorTotalEstimado"),
        F.when(F.col("awarded") > 0, F.col("awarded")).alias("valorTotalHomologado"),
        iso("published_at").alias("dataPublicacaoPncp"),
        iso("closes_at").alias("dataEncerramentoProposta"),
    )
    return n.select("notice_id", F.to_json(payload).alias("body"))


@query(
    "S1_read_notice_payloads",
    f"""WITH {NOTICE_SQL} SELECT state, modality_id + 3 AS modality_id, count(*) AS payloads, {rsum('estimate')} AS estimate,
  min(subject) AS first_subject FROM notice GROUP BY ALL""",
)
def read_notice_payloads(spark, sf):
    path = _scratch(spark, "payloads")
    payload_rows(spark, sf).select(F.col("body").alias("value")).write.text(path)
    landed = payloads.read_notice_payloads(spark, path)
    return landed.groupBy(
        F.col("unidadeOrgao.ufSigla").alias("state"), F.col("modalidadeId").alias("modality_id")
    ).agg(
        F.count(F.lit(1)).alias("payloads"),
        money_sum(F.col("valorTotalEstimado")).alias("estimate"),
        F.min("objetoCompra").alias("first_subject"),
    )


def _located(spark, sf):
    """Payloads with the target municipality joined."""
    parsed = payloads.parse_payloads(payload_rows(spark, sf), "body")
    places = municipalities(spark, sf).select(
        "ibge_code", F.col("name").alias("municipality"), "state"
    )
    return parsed.withColumn("ibge_code", payloads.unit_ibge_code()).join(places, "ibge_code")


_MODALITY_CASE = " ".join(f"WHEN {code} THEN '{name}'" for code, name in fixed.MODALITY_NAMES.items())


@query(
    "S2_flatten_notice",
    f"""WITH {NOTICE_SQL} SELECT notice_id, municipality, state, CAST(municipality_id AS VARCHAR) AS ibge_code, org_tax_id, subject,
  modality_id IN (1, 2, 3) AS small_business, CASE modality_id + 3 {_MODALITY_CASE} END AS modality, estimate, awarded, status,
  strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_at, '' AS opens_at,
  CASE WHEN sequence = 0 THEN '' ELSE 'https://pncp.gov.br/app/editais/' || org_tax_id || '/' || year || '/' || sequence END AS url,
  CAST(year AS VARCHAR) AS year, '' AS extra_info, modality_id + 3 AS modality_id, status_id, false AS price_register,
  CAST(status_id AS VARCHAR) AS legal_basis_code, CAST(year AS VARCHAR) AS year_in_raw FROM notice""",
)
def flatten_notice(spark, sf):
    flat = payloads.flatten_notice(_located(spark, sf), keep=["notice_id"])
    return flat.select(
        "notice_id", "municipality", "state", "ibge_code", "org_tax_id", "subject", "small_business", "modality",
        "estimate", "awarded", "status", "published_at", "opens_at", "url", "year", "extra_info", "modality_id",
        "status_id", "price_register", "legal_basis_code",
        F.get_json_object("raw", "$.anoCompra").alias("year_in_raw"),
    )


@query(
    "P5_in_target_area",
    f"""WITH {NOTICE_SQL}, {MUNICIPALITY_SQL} SELECT n.notice_id, m.name AS municipality FROM notice n
  JOIN municipality m USING (municipality_id) WHERE m.population <= 91692 AND m.state IN ('NATION_1', 'NATION_2', 'NATION_3')""",
)
def in_target_area(spark, sf):
    from bidscope.operators.search import in_target_area as within

    parsed = payloads.parse_payloads(payload_rows(spark, sf), "body")
    targets = municipalities(spark, sf).filter(
        (F.col("population") <= 91692) & F.col("state").isin("NATION_1", "NATION_2", "NATION_3")
    )
    return within(parsed, targets).select("notice_id", F.col("name").alias("municipality"))


def _raw_items(spark, sf):
    line = items(spark, sf, with_state=False)
    number = F.col("item_no")
    return line.select(
        "notice_id", "part_id", "supplier_id",
        F.when(number == 7, "abc").when(number == 6, "0").when(number == 5, F.lit(None))
        .otherwise(F.concat(number.cast("string"), F.lit(" "))).alias("numeroItem"),
        F.when(F.col("unit") == "kg", "  ").otherwise(F.col("description")).alias("descricao"),
        F.col("code").alias("ncmNbsCodigo"),
        F.when(F.col("unit") == "un", "n/d").otherwise(F.col("quantity").cast("string")).alias("quantidade"),
        F.col("unit").alias("unidadeMedida"),
        F.col("estimate").cast("string").alias("valorUnitarioEstimado"),
        F.lit(None).cast("string").alias("valorTotal"),
        F.col("award").isNotNull().alias("temResultado"),
        F.lit("M").alias("materialOuServico"),
        F.lit(4).alias("tipoBeneficio"),
        F.lit(1).alias("criterioJulgamentoId"),
    )


@query(
    "S3_clean_items",
    f"""WITH {PLAIN_ITEM_SQL} SELECT notice_id, part_id, supplier_id, item_no AS number, CASE WHEN unit = 'kg' THEN NULL ELSE description END AS description,
  CASE WHEN unit = 'un' THEN NULL ELSE quantity END AS quantity, estimate FROM item WHERE item_no < 5""",
)
def clean_items(spark, sf):
    return payloads.clean_items(_raw_items(spark, sf)).select(
        "notice_id", "part_id", "supplier_id", F.col("numeroItem").alias("number"),
        F.col("descricao").alias("description"), F.col("quantidade").alias("quantity"),
        F.col("valorUnitarioEstimado").alias("estimate"),
    )


def _raw_awards(spark, sf):
    line = items(spark, sf, with_state=False)
    return line.select(
        F.concat_ws("-", "notice_id", "item_no", "part_id", "supplier_id").alias("item_id"),
        F.when(F.col("item_no") == 7, "x").otherwise(F.col("item_no").cast("string")).alias("sequencialResultado"),
        F.when(F.col("unit") == "kg", F.concat(F.lit("-"), F.col("estimate").cast("string")))
        .otherwise(F.col("estimate").cast("string")).alias("valorUnitarioHomologado"),
        F.lit("").alias("valorTotalHomologado"),
        F.col("quantity").cast("string").alias("quantidadeHomologada"),
        F.lit("muito").alias("percentualDesconto"),
        F.col("supplier_id").cast("string").alias("niFornecedor"),
        F.lit(" ").alias("nomeRazaoSocialFornecedor"),
        F.lit("ME").alias("porteFornecedorNome"),
        F.date_format("created_at", "yyyy-MM-dd").alias("dataResultado"),
    )


@query(
    "S4_clean_awards",
    f"""WITH {PLAIN_ITEM_SQL} SELECT notice_id || '-' || item_no || '-' || part_id || '-' || supplier_id AS item_id, item_no AS sequence,
  estimate AS unit_award, CAST(NULL AS DOUBLE) AS total_award, quantity, CAST(NULL AS VARCHAR) AS supplier
FROM item WHERE item_no <> 7 AND unit <> 'kg'""",
)
def clean_awards(spark, sf):
    return payloads.clean_awards(_raw_awards(spark, sf)).select(
        "item_id", F.col("sequencialResultado").alias("sequence"),
        F.col("valorUnitarioHomologado").alias("unit_award"), F.col("valorTotalHomologado").alias("total_award"),
        F.col("quantidadeHomologada").alias("quantity"), F.col("nomeRazaoSocialFornecedor").alias("supplier"),
    )


@query(
    "S5_build_item_rows",
    f"""WITH {NOTICE_SQL}, {PLAIN_ITEM_SQL} SELECT sha256('PNCP:' || org_tax_id || ':' || year || ':' || sequence)[1:32] AS notice_hash,
  i.part_id, item_no, i.platform, n.state, n.modality_id, has AS has_award FROM (SELECT *, award IS NOT NULL AS has FROM item) i
  JOIN notice n USING (notice_id) WHERE item_no < 5""",
)
def build_item_rows(spark, sf):
    meta = notices(spark, sf).select(
        "notice_id", "org_tax_id", "year", "sequence", F.lit(None).cast("string").alias("notice_hash"),
        "state", "municipality", F.col("municipality_id").cast("string").alias("ibge_code"), "modality_id",
    )
    clean = payloads.clean_items(_raw_items(spark, sf)).withColumns({
        "platform_id": (F.col("supplier_id") % 7).cast("int"),
        "platform": F.concat(F.lit("P"), (F.col("supplier_id") % 7).cast("string")),
    })
    clean = clean.withColumn("descricao", F.col("part_id").cast("string"))
    rows = payloads.build_item_rows(clean.join(meta, "notice_id"), as_of())
    return rows.select(
        "notice_hash", F.col("description").cast("long").alias("part_id"), "item_no", "platform", "state",
        "modality_id", "has_award",
    )


@query(
    "S6_build_award_rows",
    f"""WITH {PLAIN_ITEM_SQL} SELECT supplier_id, supplier_size, count(*) AS awards, {rsum('estimate')} AS unit_awards FROM (
  SELECT CAST(supplier_id AS VARCHAR) AS supplier_id, 'ME' AS supplier_size, estimate FROM item WHERE item_no <> 7 AND unit <> 'kg') GROUP BY ALL""",
)
def build_award_rows(spark, sf):
    rows = payloads.build_award_rows(payloads.clean_awards(_raw_awards(spark, sf)), as_of())
    return rows.groupBy("supplier_id", "supplier_size").agg(
        F.count(F.lit(1)).alias("awards"),
        money_sum(F.col("unit_award")).alias("unit_awards"),
    )


_KEY = "l_orderkey, l_linenumber"
_LATEST = "l_shipdate DESC, l_partkey, l_suppkey"


@query(
    "S7_upsert_by_key",
    f"""WITH fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY {_LATEST}) AS rn
    FROM lineitem WHERE l_linestatus = 'O') WHERE rn = 1)
SELECT {_KEY}, l_partkey, l_suppkey, l_linestatus FROM lineitem t WHERE l_linestatus = 'F' AND NOT EXISTS (
  SELECT 1 FROM fresh f WHERE f.l_orderkey = t.l_orderkey AND f.l_linenumber = t.l_linenumber)
UNION ALL SELECT {_KEY}, l_partkey, l_suppkey, l_linestatus FROM fresh""",
)
def upsert_by_key(spark, sf):
    rows = table(spark, sf, "lineitem")
    order = [F.col("l_shipdate").desc(), F.col("l_partkey"), F.col("l_suppkey")]
    merged = tables.upsert_by_key(
        rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'"), ["l_orderkey", "l_linenumber"], order
    )
    return merged.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")


@query(
    "S8_replace_partition",
    f"""SELECT o_orderstatus, count(*) AS notices, {rsum("CASE WHEN o_orderstatus = 'F' THEN 2 * o_totalprice ELSE o_totalprice END")} AS total
FROM orders GROUP BY o_orderstatus""",
)
def replace_partition(spark, sf):
    path = _scratch(spark, "partitions")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    tables.replace_partitions(rows, path, ["o_orderstatus"])
    doubled = rows.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    tables.replace_partitions(doubled, path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("notices"),
        money_sum(F.col("o_totalprice")).alias("total"),
    )


@query(
    "S9_insert_ignore",
    f"""SELECT {_KEY}, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY {_LATEST}) AS rn FROM lineitem t
  WHERE l_linestatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem f WHERE f.l_linestatus = 'F'
    AND f.l_orderkey = t.l_orderkey AND f.l_linenumber = t.l_linenumber)) WHERE rn = 1""",
)
def insert_ignore(spark, sf):
    rows = table(spark, sf, "lineitem")
    order = [F.col("l_shipdate").desc(), F.col("l_partkey"), F.col("l_suppkey")]
    added = tables.insert_ignore(
        rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'"), ["l_orderkey", "l_linenumber"], order
    )
    return added.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _population_series(spark, sf):
    m = municipalities(spark, sf)
    latest = F.when(F.col("population") == 0, "-").otherwise(F.col("population").cast("string"))
    return m.select("ibge_code", F.lit(2024).alias("year"), latest.alias("value")).union(
        m.select("ibge_code", F.lit(2020), F.lit("1"))
    )


_POP = "CASE WHEN population = 0 THEN 999999 ELSE population END"
_FPM = " ".join(f"WHEN p <= {limit} THEN {value}" for limit, value in fixed.FPM_STEPS)


@query("W9_latest_population", f"WITH {MUNICIPALITY_SQL} SELECT ibge_code, NULLIF(population, 0) AS population FROM municipality")
def latest_population(spark, sf):
    return dims.latest_population(_population_series(spark, sf))


@query(
    "S10_build_municipality_dim",
    f"""WITH {MUNICIPALITY_SQL}, m AS (SELECT *, {_POP} AS p FROM municipality)
SELECT ibge_code, name, state, p AS population, CAST(CASE {_FPM} ELSE 4.0 END AS DOUBLE) AS fpm, microregion_id FROM m
WHERE p <= 91692 AND state IN ('NATION_4', 'NATION_5', 'NATION_6', 'NATION_7')""",
)
def build_municipality_dim(spark, sf):
    base = municipalities(spark, sf).select("ibge_code", "name", "state", "microregion_id")
    states = ["NATION_4", "NATION_5", "NATION_6", "NATION_7"]
    rows = dims.build_municipality_dim(base, _population_series(spark, sf), states, 91692)
    return rows.select("ibge_code", "name", "state", "population", "fpm", "microregion_id")


@query(
    "S11_build_microregion_dim",
    """SELECT n_nationkey AS microregion_id, n_name AS state, CASE WHEN n_regionkey < 3 THEN r_name ELSE '' END AS name,
  CASE WHEN n_regionkey < 3 THEN n_regionkey ELSE 0 END AS mesoregion_id FROM nation JOIN region ON r_regionkey = n_regionkey
WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""",
)
def build_microregion_dim(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).filter("r_regionkey < 3").select(
        F.col("n_nationkey").alias("microregion_id"), F.col("r_name").alias("name"),
        F.col("r_regionkey").alias("mesoregion_id"), F.col("r_name").alias("mesoregion_name"),
    )
    states = [f"NATION_{i}" for i in range(25)]
    rows = dims.build_microregion_dim(municipalities(spark, sf), names, states)
    return rows.select("microregion_id", "state", "name", "mesoregion_id")


_PLATFORM_ROWS = ", ".join(
    f"({i}, '{name}', '{kind}')" for i, name, kind in fixed.PLATFORMS
)


@query(
    "S12_platform_dim",
    f"""WITH p(id, name, kind) AS (VALUES {_PLATFORM_ROWS})
SELECT CAST(l_suppkey % 150 AS INTEGER) AS platform_id, coalesce(name, 'Plataforma #' || (l_suppkey % 150)) AS platform, kind AS platform_type,
  count(*) AS items FROM lineitem LEFT JOIN p ON id = l_suppkey % 150 GROUP BY ALL""",
)
def platform_dim(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 150).cast("int").alias("platform_id")).agg(
        F.count(F.lit(1)).alias("items")
    )
    return dims.with_platform_name(counts, spark).select("platform_id", "platform", "platform_type", "items")


_DOMAIN_ROWS = ", ".join(f"({c}, '{n}')" for c, n in fixed.DOMAIN_CODES["modalidade_contratacao"].items())


@query(
    "S13_domain_code_dim",
    f"""WITH d(code, name) AS (VALUES {_DOMAIN_ROWS}), {NOTICE_SQL}
SELECT modality_id, name AS modality_name, count(*) AS notices FROM notice JOIN d ON code = modality_id GROUP BY ALL""",
)
def domain_code_dim(spark, sf):
    named = dims.with_domain_name(
        notices(spark, sf).select("modality_id"), spark, "modalidade_contratacao", "modality_id", "modality_name"
    )
    return named.groupBy("modality_id", "modality_name").agg(F.count(F.lit(1)).alias("notices"))


def gazettes(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", (F.col("doc_id") % 97).cast("string").alias("territory_id"), F.col("source").alias("territory_name"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int")), "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit('"'), F.col("lang"), F.lit('" edital')).alias("query"),
        F.split("text", "; |\\. ").alias("excerpts"),
    )


@query(
    "S14_gazette_to_notice",
    f"""WITH {MUNICIPALITY_SQL}, e AS (SELECT doc_id, CAST(doc_id % 97 AS VARCHAR) AS territory_id,
    strftime(DATE '2024-01-01' + CAST(doc_id % 5 AS INTEGER), '%Y-%m-%d') AS day, lang || ' edital' AS q, source,
    unnest(string_split_regex(text, '; |\\. ')) AS ex FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY territory_id, day, ex ORDER BY q, doc_id) AS rn
  FROM e JOIN municipality ON ibge_code = territory_id)
SELECT doc_id, name AS municipality, source AS org_name, md5(trim(replace(ex, chr(10), ' '))) AS subject, day || 'T00:00:00' AS published_at,
  q AS keywords, day[1:4] AS year FROM f WHERE rn = 1 AND length(trim(replace(ex, chr(10), ' '))) >= 1""",
)
def gazette_to_notice(spark, sf):
    rows = feeds.gazette_to_notice(gazettes(spark, sf), municipalities(spark, sf), keep=["doc_id"])
    return rows.select(
        "doc_id", "municipality", "org_name", F.md5("subject").alias("subject"), "published_at", "keywords", "year"
    )


def _court_records(spark, sf):
    return notices(spark, sf).select(
        "notice_id", F.lower("municipality").alias("municipality"),
        F.col("municipality_id").cast("string").alias("ibge_code"), "year",
        (F.col("sequence") % 10).cast("string").alias("number"), "subject", F.col("state").alias("unit"), "modality",
        "estimate", F.date_format("published_at", "yyyy-MM-dd").alias("published_at"),
        F.when(F.col("status") == "F", "2001-01-01").alias("awarded_at"),
    )


@query(
    "S15_audit_court_to_notice",
    f"""WITH {NOTICE_SQL}, k AS (SELECT *, lower(subject) AS s, row_number() OVER (PARTITION BY municipality, sequence % 10, year
  ORDER BY published_at, subject, notice_id) AS rn FROM notice WHERE lower(subject) LIKE '%urgent%' OR lower(subject) LIKE '%build%')
SELECT notice_id, lower(municipality) AS municipality, CASE WHEN status = 'F' THEN 'Homologada' ELSE 'Publicada' END AS status,
  CASE WHEN s LIKE '%urgent%' AND s LIKE '%build%' THEN 'Urgent, BUILD' WHEN s LIKE '%urgent%' THEN 'Urgent' ELSE 'BUILD' END AS keywords,
  CASE WHEN s LIKE '%urgent%' THEN 'ALTA' WHEN s LIKE '%medium%' THEN 'MEDIA' ELSE 'BAIXA' END AS relevance,
  strftime(published_at, '%Y-%m-%dT00:00:00') AS published_at FROM k WHERE rn = 1""",
)
def audit_court_to_notice(spark, sf):
    rows = feeds.audit_court_to_notice(
        _court_records(spark, sf), ["Urgent", "BUILD"], ["urgent"], ["medium"], keep=["notice_id"]
    )
    return rows.select("notice_id", "municipality", "status", "keywords", "relevance", "published_at")


def _portal_replies(spark, sf):
    n = notices(spark, sf)
    day = F.date_format("published_at", "yyyy-MM-dd")
    kind = F.col("modality_id")
    record = F.struct(
        F.when(kind <= 3, F.col("subject")).alias("objeto"), F.when(kind == 4, F.col("subject")).alias("descricao"),
        F.when(kind == 2, day).alias("data_publicacao"), day.alias("data_abertura"),
        F.when(kind == 1, F.col("estimate")).alias("valor_estimado"), F.col("estimate").alias("valor"),
        F.col("notice_id").cast("string").alias("numero"), F.when(kind == 3, F.col("status")).alias("status"),
    )
    listed = F.to_json(F.array(record))
    body = (
        F.when(kind == 1, listed)
        .when(kind == 2, F.concat(F.lit('{"data":'), listed, F.lit("}")))
        .when(kind == 3, F.concat(F.lit('{"items":'), listed, F.lit("}")))
        .otherwise(F.concat(F.lit('{"licitacoes":'), listed, F.lit("}")))
    )
    return n.select("notice_id", body.alias("body"))


@query(
    "S16_portal_api_to_notice",
    f"""WITH {NOTICE_SQL} SELECT notice_id, subject, strftime(published_at, '%Y-%m-%dT00:00:00') AS published_at, estimate,
  CAST(notice_id AS VARCHAR) AS process_number, CASE WHEN modality_id = 3 THEN status ELSE 'Publicada' END AS status
FROM notice WHERE modality_id <= 4""",
)
def portal_api_to_notice(spark, sf):
    rows = feeds.portal_api_to_notice(_portal_replies(spark, sf), "body", ["notice_id"])
    return rows.select("notice_id", "subject", "published_at", "estimate", "process_number", "status")


def listing_pages(spark, sf):
    """One listing page per order: a table with one row."""
    n = notices(spark, sf)
    shown = F.translate(F.format_number("estimate", 2), ",.", ".,")
    html = F.concat(
        F.lit("<html><body><table class='x'><tr><th>Processo</th><th> Objeto </th><th>Data</th><th>Abertura</th><th>Valor</th></tr><tr><td>"),
        F.col("notice_id").cast("string"), F.lit("/"), F.col("year").cast("string"), F.lit("</td><td><a href='/n/"),
        F.col("notice_id").cast("string"), F.lit("'>"), F.col("subject"), F.lit("</a> convite</td><td>"),
        F.date_format("published_at", "dd/MM/yyyy"), F.lit("</td><td>"), F.date_format("closes_at", "dd/MM/yy"),
        F.lit("</td><td>R$ "), shown, F.lit("</td></tr></table></body></html>"),
    )
    return n.select(
        "notice_id", F.col("municipality_id").cast("string").alias("ibge_code"),
        F.lit("https://town.example.org/licitacoes?x=1").alias("url"), html.alias("html"),
    )


@query(
    "S17_portal_table_pages",
    f"""WITH {NOTICE_SQL} SELECT notice_id, subject || 'convite' AS subject, 'Convite' AS modality,
  strftime(published_at, '%Y-%m-%dT00:00:00') AS published_at, strftime(closes_at, '%Y-%m-%dT00:00:00') AS opens_at, estimate,
  notice_id || '/' || year AS process_number, 'Publicada' AS status, 'https://town.example.org/n/' || notice_id AS url
FROM notice WHERE published_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'""",
)
def portal_table_pages(spark, sf):
    rows = feeds.portal_pages_to_notice(listing_pages(spark, sf), "notice_id", "1996-01-01", "2000-12-31")
    return rows.drop("closes_at")


@query(
    "S17_portal_card_pages",
    """WITH b AS (SELECT page_id, url, unnest(string_split(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g'),
    '<p>')[2:]) AS piece FROM pages),
c AS (SELECT page_id, url, string_split(replace(piece, '</p>', ''), '</article>')[1] AS inner_html FROM b),
t AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(replace(array_to_string(list_filter(list_transform(
    string_split(regexp_replace(inner_html, '<[^>]*>', chr(1), 'g'), chr(1)), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> ''), ' '),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&amp;', '&') AS txt FROM c)
SELECT page_id, md5(txt) AS subject, url FROM t WHERE length(txt) >= 20""",
)
def portal_card_pages(spark, sf):
    # every paragraph of the pages becomes a card block
    pages = table(spark, sf, "pages")
    opened = F.replace("html", F.lit("<p>"), F.lit('</div><div class="card licitacao">'))
    carded = F.replace(opened, F.lit("</p>"), F.lit(""))
    rows = feeds.portal_pages_to_notice(pages.select("page_id", "url", carded.alias("html")), "page_id")
    return rows.select("page_id", F.md5("subject").alias("subject"), "url")


@query(
    "S17_portal_heading_pages",
    f"""WITH {NOTICE_SQL}, h AS (SELECT notice_id, 'Licitação' || subject || 'n. ' || notice_id || '/' || year AS subject, 'https://town.example.org/licitacoes?x=1' AS url FROM notice
  UNION ALL SELECT notice_id, 'Todos os editais da prefeitura ' || municipality, 'https://town.example.org/e/' || notice_id FROM notice) SELECT * FROM h WHERE length(subject) > 20""",
)
def portal_heading_pages(spark, sf):
    # pages without tables and cards: headings and links that name a procurement, among others that do not;
    # the pieces of a heading are trimmed and put together without blanks
    n = notices(spark, sf)
    html = F.concat(
        F.lit("<html><body><h1>Editais e licitações desta prefeitura</h1><h3>Notícias da semana passada</h3><h2>Licitação <b>"), F.col("subject"),
        F.lit("</b> n. "), F.col("notice_id").cast("string"), F.lit("/"), F.col("year").cast("string"), F.lit("</h2><p><a href='/e/"),
        F.col("notice_id").cast("string"), F.lit("'>Todos os editais da prefeitura "), F.col("municipality"), F.lit("</a><a href='/x'>editais</a></p></body></html>"),
    )
    pages = n.select("notice_id", F.lit("https://town.example.org/licitacoes?x=1").alias("url"), html.alias("html"))
    return feeds.portal_pages_to_notice(pages, "notice_id").select("notice_id", "subject", "url")


@query(
    "S18_normalize_portal_row",
    f"""WITH {NOTICE_SQL} SELECT municipality, state, org_name, modality, relevance, source, year, count(*) AS notices, {rsum('estimate')} AS estimate FROM (
  SELECT municipality, state, municipality AS org_name, 'Convite' AS modality, 'BAIXA' AS relevance, 'PORTAL_MUNICIPAL' AS source,
    CAST(year AS VARCHAR) AS year, estimate FROM notice) GROUP BY ALL""",
)
def normalize_portal_row(spark, sf):
    pages = listing_pages(spark, sf)
    rows = feeds.table_listings(pages, ["notice_id", "ibge_code"])
    return feeds.normalize_portal_row(rows, municipalities(spark, sf)).groupBy(
        "municipality", "state", "org_name", "modality", "relevance", "source", "year"
    ).agg(
        F.count(F.lit(1)).alias("notices"),
        money_sum(F.col("estimate")).alias("estimate"),
    )


@query(
    "S19_union_sources",
    f"""WITH {NOTICE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY municipality, sequence % 10, year ORDER BY published_at, subject, notice_id) AS rn
  FROM notice WHERE lower(subject) LIKE '%urgent%' OR lower(subject) LIKE '%build%')
SELECT 'PNCP' AS source, count(*) AS notices, {rsum('awarded')} AS awarded FROM notice UNION ALL
SELECT 'TCE_RJ', count(*), 0.0 FROM k WHERE rn = 1 UNION ALL SELECT 'PORTAL_MUNICIPAL', count(*), 0.0 FROM notice""",
)
def union_sources(spark, sf):
    flat = payloads.flatten_notice(_located(spark, sf))
    court = feeds.audit_court_to_notice(_court_records(spark, sf), ["Urgent", "BUILD"])
    pages = feeds.table_listings(listing_pages(spark, sf), ["notice_id", "ibge_code"])
    portal = feeds.normalize_portal_row(pages, municipalities(spark, sf))
    return feeds.union_sources([flat, court, portal]).groupBy("source").agg(
        F.count(F.lit(1)).alias("notices"),
        money_sum(F.col("awarded")).alias("awarded"),
    )


@query(
    "S20_extract_from_raw",
    f"""WITH {NOTICE_SQL} SELECT notice_id, CASE WHEN status = 'F' THEN -1 ELSE modality_id + 3 END AS modality_id,
  CASE WHEN status = 'F' THEN NULL ELSE modality_id END AS dispute_mode_id FROM notice""",
)
def extract_from_raw(spark, sf):
    stored = payload_rows(spark, sf).withColumnRenamed("body", "raw").join(
        notices(spark, sf).select("notice_id", "source", F.when(F.col("status") == "F", -1).alias("modality_id")), "notice_id"
    )
    blank = F.lit(None).cast("int")
    stored = stored.withColumns({"dispute_mode_id": blank, "status_id": blank})
    return payloads.extract_from_raw(stored).select("notice_id", "modality_id", "dispute_mode_id")


@query(
    "S21_report_export",
    f"""WITH {NOTICE_SQL} SELECT relevance AS "Relevância", municipality AS "Município", state AS "UF", count(*) AS notices,
  {rsum('estimate')} AS total FROM notice GROUP BY ALL""",
)
def report_export(spark, sf):
    from bidscope.plans.insight import report_export as export

    path = _scratch(spark, "report")
    export(notices(spark, sf), path)
    back = spark.read.csv(path, header=True, escape='"')
    return back.groupBy("Relevância", "Município", "UF").agg(
        F.count(F.lit(1)).alias("notices"),
        money_sum(F.col("Valor Estimado").cast("double")).alias("total"),
    )


@query(
    "S22_collection_metrics",
    f"""WITH {PLAIN_ITEM_SQL} SELECT notice_id % 10 AS batch, count(*) AS returned, count(*) FILTER (item_no < 5) AS valid,
  count(*) FILTER (item_no >= 5) AS dropped, count(*) FILTER (item_no < 5 AND code = 'SMALL') AS persisted FROM item GROUP BY ALL""",
)
def collection_metrics(spark, sf):
    checked = payloads.check_items(_raw_items(spark, sf)).withColumn("batch", F.col("notice_id") % 10)
    return payloads.collection_metrics(checked, ["batch"], F.col("ncmNbsCodigo") == "SMALL")


@query(
    "S22_failures_by_class",
    f"""WITH {PLAIN_ITEM_SQL} SELECT CASE item_no WHEN 5 THEN 'missing number' WHEN 6 THEN 'number not positive' ELSE 'number not an integer' END AS reject_reason,
  count(*) AS failures FROM item WHERE item_no >= 5 GROUP BY ALL""",
)
def failures_by_class(spark, sf):
    return payloads.failures_by_class(payloads.check_items(_raw_items(spark, sf)))


_REASONS = ["missing number", "number not an integer", "number not positive"]


@query(
    "S22_observed_metrics",
    f"""WITH {PLAIN_ITEM_SQL} SELECT unnest(['returned', 'valid', 'dropped', 'persisted', 'missing number', 'number not positive', 'number not an integer']) AS metric,
  unnest([count(*), count(*) FILTER (item_no < 5), count(*) FILTER (item_no >= 5), count(*) FILTER (item_no < 5 AND code = 'SMALL'), count(*) FILTER (item_no = 5),
    count(*) FILTER (item_no = 6), count(*) FILTER (item_no > 6)]) AS rows_n FROM item""",
)
def observed_metrics(spark, sf):
    """Counts gathered while the valid items are written."""
    checked = payloads.check_items(_raw_items(spark, sf))
    rows, seen = payloads.observe_collection(checked, F.col("ncmNbsCodigo") == "SMALL", _REASONS)
    stage(rows.filter("reject_reason is null").select("notice_id", "numeroItem"), "valid-items")
    return spark.createDataFrame(list(seen.get.items()), "metric string, rows_n bigint")


_EXPIRED = f"(NOT is_open AND awarded > 0 AND closes_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY)"


@query(
    "S23_retention_delete",
    f"""WITH {NOTICE_SQL}, {PLAIN_ITEM_SQL}, kept AS (SELECT notice_id FROM notice WHERE NOT {_EXPIRED})
SELECT notice_id, count(*) AS items FROM item WHERE notice_id IN (SELECT notice_id FROM kept) GROUP BY notice_id""",
)
def retention_delete(spark, sf):
    flagged = tables.retention_split(notices(spark, sf), as_of())
    kept = tables.cascade(items(spark, sf, with_state=False), flagged.filter("not expired"), "notice_id")
    return kept.groupBy("notice_id").agg(F.count(F.lit(1)).alias("items"))


@query(
    "S23_retention_counts",
    f"""WITH {NOTICE_SQL} SELECT count(*) FILTER ({_EXPIRED}) AS removed, count(*) FILTER (is_open) AS kept_open,
  count(*) FILTER (NOT is_open AND awarded = 0) AS kept_not_awarded, count(*) AS total FROM notice""",
)
def retention_counts(spark, sf):
    return tables.retention_counts(notices(spark, sf), as_of())


def scrape_log(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("ibge_code"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), "value",
    )


_REGISTRY = """registry AS (SELECT CAST(c_custkey AS VARCHAR) AS ibge_code, 'https://' || c_custkey || '.example.org' AS base_url, c_custkey % 3 > 0 AS active
  FROM customer WHERE c_mktsegment <> 'MACHINERY')"""


def portal_registry(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment <> 'MACHINERY'")
    return c.select(
        F.col("c_custkey").cast("string").alias("ibge_code"),
        F.concat(F.lit("https://"), F.col("c_custkey").cast("string"), F.lit(".example.org")).alias("base_url"),
        (F.col("c_custkey") % 3 > 0).alias("active"),
    )


@query(
    "P16_recent_success_guard",
    f"""WITH {MUNICIPALITY_SQL}, last AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT ibge_code FROM municipality LEFT JOIN last ON CAST(user_id AS VARCHAR) = ibge_code
WHERE t IS NULL OR floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(t)) >= 43200""",
)
def recent_success_guard(spark, sf):
    targets = municipalities(spark, sf).select("ibge_code")
    return dims.due_for_scrape(targets, scrape_log(spark, sf), F.lit("2024-01-31").cast("timestamp"))


@query(
    "P17_portal_target_set",
    f"""WITH {MUNICIPALITY_SQL}, {_REGISTRY} SELECT ibge_code, name, base_url FROM municipality JOIN registry USING (ibge_code)
WHERE active AND microregion_id IN (1, 2, 3, 4, 5)""",
)
def portal_target_set(spark, sf):
    rows = dims.portal_targets(municipalities(spark, sf), portal_registry(spark, sf), [1, 2, 3, 4, 5], 91692)
    return rows.select("ibge_code", "name", "base_url")


@query(
    "J18_backfill_hash",
    f"""WITH {NOTICE_SQL}, {PLAIN_ITEM_SQL} SELECT item_no, part_id, supplier_id, notice_id, CASE WHEN unit = 'un' THEN 'known'
  ELSE sha256('PNCP:' || org_tax_id || ':' || year || ':' || sequence)[1:32] END AS notice_hash FROM item JOIN notice USING (notice_id)""",
)
def backfill_hash(spark, sf):
    rows = items(spark, sf, with_state=False).join(
        notices(spark, sf).select("notice_id", "org_tax_id", "year", "sequence"), "notice_id"
    ).withColumn("notice_hash", F.when(F.col("unit") == "un", "known"))
    return tables.backfill_hash(rows).select("item_no", "part_id", "supplier_id", "notice_id", "notice_hash")


@query(
    "J17_backfill_geo",
    f"""WITH {NOTICE_SQL}, {PLAIN_ITEM_SQL}, org AS (SELECT org_tax_id, arg_min(municipality, (published_at,
    sha256('PNCP:' || org_tax_id || ':' || year || ':' || sequence)[1:32])) AS m FROM notice GROUP BY org_tax_id)
SELECT item_no, part_id, supplier_id, notice_id, CASE WHEN unit = 'un' THEN '?' ELSE CAST(municipality_id AS VARCHAR) END AS ibge_code,
  CASE WHEN unit = 'un' THEN NULL ELSE n.state END AS state FROM item JOIN notice n USING (notice_id)""",
)
def backfill_geo(spark, sf):
    n = notices(spark, sf).withColumn(
        "notice_hash", notice_hash(F.col("source"), F.col("org_tax_id"), F.col("year"), F.col("sequence"))
    )
    link = n.select("notice_id", "org_tax_id", F.when(F.col("status") != "P", F.col("notice_hash")).alias("notice_hash"))
    rows = items(spark, sf, with_state=False).join(link, "notice_id").withColumns({
        "ibge_code": F.when(F.col("unit") == "un", "?"),
        "state": F.lit(None).cast("string"),
        "municipality": F.lit(None).cast("string"),
    })
    filled = tables.backfill_geo(rows, n, municipalities(spark, sf), spread=["notice_id", "item_no"])
    return filled.select("item_no", "part_id", "supplier_id", "notice_id", "ibge_code", "state")


@query(
    "J23_mark_collected",
    f"""WITH {NOTICE_SQL} SELECT notice_id, notice_id IN (SELECT l_orderkey FROM lineitem) AS items_collected FROM notice""",
)
def mark_collected(spark, sf):
    n = notices(spark, sf).withColumns({
        "notice_hash": F.col("notice_id").cast("string"), "items_collected": F.lit(False)
    })
    present = items(spark, sf, with_state=False).select(F.col("notice_id").cast("string").alias("notice_hash"))
    return tables.mark_collected(n, present).select("notice_id", "items_collected")
