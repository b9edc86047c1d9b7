"""Tender-document analysis over whole documents.

The documents hold invented prose, so every document gets tender clauses in front, chosen
and numbered by its id; the whole text is analysed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.checks.q_scalars import sql_list
from bidscope.checks.registry import query
from bidscope.checks.star import r, table
from bidscope.functions import fixed_values as fixed
from bidscope.operators import documents as ops
from bidscope.plans.documents import analyze_documents

CLAUSES = [
    "EDITAL DE LICITAÇÃO. Pregão eletrônico, modalidade e objeto do contrato conforme cláusula {n}.",
    "Prazo de implantação: {n} (trinta) dias corridos.",
    "Certidão negativa de débitos junto à fazenda FEDERAL.",
    "certidão   negativa de\ntributos municipal; Atestado de capacidade técnica",
    "Página {n} de 99",
    "- {n} -",
    "A contratada deverá apresentar comprovação de experiência mínima de {n} anos em serviços semelhantes.",
    "Multa de {n}% sobre o valor total da contratação em caso de atraso na execu-\nção dos serviços.",
    "SANÇÃO administrativa e suspensão temporária de participação em certames futuros por falta.",
    "Impedimento de contratar com a administração pública por até dois anos após a falta.",
    "Qualificação técnica: comprovar execução anterior de objeto semelhante no porte {n}.",
    "Capital social mínimo de R$ {n}.000,00 e balanço patrimonial do último exercício.",
    "No prazo de {n} dias a proposta será julgada; garantia de proposta exigida; em até {n} meses o pagamento.",
    "O sistema deve permitir integração com os módulos de contabilidade e tributos do município {n}.",
]


def _sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tender_docs(spark, sf):
    number = (F.col("doc_id") % 60 + 1).cast("string")
    parts = [
        F.when((F.col("doc_id") + i) % 3 == 0, F.replace(F.lit(clause), F.lit("{n}"), number))
        for i, clause in enumerate(CLAUSES)
    ]
    full = F.concat_ws("\n", *parts, "text")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("notice_id"), full.alias("text"))


_PARTS = ", ".join(
    f"CASE WHEN (doc_id + {i}) % 3 = 0 THEN replace({_sql_string(c)}, '{{n}}', CAST(doc_id % 60 + 1 AS VARCHAR)) END"
    for i, c in enumerate(CLAUSES)
)
DOCS_SQL = f"docs AS (SELECT doc_id AS notice_id, concat_ws(chr(10), {_PARTS}, text) AS text FROM documents)"

_CLEAN = "text"
for _pattern, _replacement in (
    (r"[\x00-\x08\x0b\x0e-\x1f\x7f-\x{9f}]", ""), (r"(?i)p[áa]g(?:ina)?\.?\s*\d+\s*(?:de|/)\s*\d+", ""),
    (r"(?m)^\s*-?\s*\d{1,3}\s*-?\s*$", ""), (r"-\s*\n\s*", ""),
    (r"([a-záéíóúâêôãõç])\s*\n\s*([a-záéíóúâêôãõç])", r"\1 \2"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
):
    _CLEAN = f"regexp_replace({_CLEAN}, {_sql_string(_pattern)}, {_sql_string(_replacement)}, 'g')"
CLEAN_SQL = f"{DOCS_SQL}, clean AS (SELECT notice_id, text, {_CLEAN} AS c FROM docs)"


@query("T1_clean_doc_text", f"WITH {CLEAN_SQL} SELECT notice_id, length(c) AS chars, md5(c) AS digest FROM clean")
def clean_doc_text(spark, sf):
    clean = ops.clean_doc_text(F.col("text"))
    return tender_docs(spark, sf).select("notice_id", F.length(clean).cast("long").alias("chars"), F.md5(clean).alias("digest"))


_LEGAL = f"len(list_filter({sql_list(fixed.LEGAL_TERMS)}, lambda t: contains(lower(text), t)))"
_QUALITY = f"""{DOCS_SQL}, q AS (SELECT notice_id, text, length(text) AS n, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / length(text) AS alpha, {_LEGAL} AS legal,
  list_filter(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') AS lines FROM docs),
q2 AS (SELECT *, len(list_filter(lines, lambda x: len(regexp_extract_all(x, '\\S+')) < 3)) / len(lines) AS broken FROM q),
q3 AS (SELECT *, {r('''((CASE WHEN n >= 10000 THEN 25 WHEN n >= 5000 THEN 20 WHEN n >= 1000 THEN 10 ELSE 0 END)
  + (CASE WHEN alpha >= 0.7 THEN 25 WHEN alpha >= 0.5 THEN 15 ELSE 5 END) + 25 * least(legal / 10, 1.0)
  + (CASE WHEN broken < 0.3 THEN 25 WHEN broken < 0.5 THEN 15 ELSE 5 END)) / 100''')} AS quality FROM q2)"""


@query(
    "T2_doc_quality",
    f"""WITH {_QUALITY} SELECT notice_id, quality, CASE WHEN quality >= 0.7 THEN 'boa' WHEN quality >= 0.4 THEN 'regular' ELSE 'ruim' END AS quality_band,
  (CASE WHEN n >= 10000 THEN 'texto longo (bom)' WHEN n >= 5000 THEN 'texto suficiente' WHEN n >= 1000 THEN 'texto curto' ELSE 'texto muito curto' END) AS first_reason FROM q3""",
)
def doc_quality(spark, sf):
    rows = ops.doc_quality(tender_docs(spark, sf), "text")
    return rows.select("notice_id", "quality", "quality_band", F.col("quality_reasons")[0].alias("first_reason"))


@query("T3_page_count", "SELECT doc_id, len(string_split(replace(text, '. ', chr(12)), chr(12))) AS pages FROM documents")
def page_count(spark, sf):
    # sentence ends stand for form feeds
    text = F.replace("text", F.lit(". "), F.lit("\f"))
    return table(spark, sf, "documents").select("doc_id", ops.page_count(text).cast("long").alias("pages"))


def _re2(pattern: str) -> str:
    return "(?i)" + pattern.replace(r"[\w\s]", r"[\p{L}\p{N}_\s]")


def findings_sql(kind: str) -> str:
    patterns = ops.FINDINGS[kind]
    rows = " UNION ALL ".join(
        f"SELECT notice_id, {i} AS p, '{code}' AS code, m, pos FROM (SELECT notice_id, unnest(l) AS m, generate_subscripts(l, 1) AS pos FROM "
        f"(SELECT notice_id, regexp_extract_all(c, {_sql_string(_re2(pattern))}) AS l FROM clean))"
        for i, (code, _, pattern) in enumerate(patterns)
    )
    return f"""{kind}_raw AS ({rows}),
{kind}_cut AS (SELECT notice_id, p, pos, code, trim(regexp_replace(m, '\\s+', ' ', 'g')) AS snippet FROM {kind}_raw),
{kind}_one AS (SELECT *, row_number() OVER (PARTITION BY notice_id, snippet ORDER BY p, pos) AS dup FROM {kind}_cut WHERE length(snippet) > 10),
f_{kind} AS (SELECT notice_id, code, snippet, CAST(rn - 1 AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY p, pos) AS rn FROM {kind}_one WHERE dup = 1))"""


_CONFIDENCE = "CAST(CASE WHEN length(snippet) >= 50 THEN 0.9 WHEN length(snippet) >= 30 THEN 0.8 WHEN length(snippet) >= 15 THEN 0.7 ELSE 0.5 END AS DOUBLE)"


def _cleaned(spark, sf):
    from bidscope.operators.skew import evaluate_once
    from bidscope.session import spread

    return evaluate_once(spread(tender_docs(spark, sf)), clean=ops.clean_doc_text(F.col("text")))


def _register_findings(name: str, kind: str) -> None:
    @query(name, f"WITH {CLEAN_SQL}, {findings_sql(kind)} SELECT notice_id, position, code, snippet, {_CONFIDENCE} AS confidence FROM f_{kind}")
    def findings(spark, sf):
        found = ops.with_findings(_cleaned(spark, sf).select("notice_id", "clean"), "clean", [kind])
        return ops.findings_long(found, "notice_id", [kind]).select("notice_id", "position", "code", "snippet", "confidence")


_register_findings("T4_find_required_documents", "documents")
_register_findings("T5_find_requirements", "requirements")
_register_findings("T6_find_risks", "risks")
_register_findings("T7_find_qualifications", "qualifications")


@query(
    "T8_finding_confidence",
    f"""SELECT doc_id, position, {_CONFIDENCE} AS confidence FROM (SELECT doc_id, unnest(l) AS snippet,
  CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS position FROM (SELECT doc_id, string_split(text, '.') AS l FROM documents))""",
)
def finding_confidence(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "[.]")).alias("position", "snippet"))
    return rows.select("doc_id", "position", ops.finding_confidence(F.col("snippet")).alias("confidence"))


_KIND = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(ctx, '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in fixed.DEADLINE_KINDS
) + " ELSE 'outros' END"


def deadlines_sql() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT notice_id, {i} AS p, c, i AS pos, m[i] AS whole, a[i] AS amount, u[i] AS unit,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT notice_id, c, string_split_regex(c, {_sql_string(_re2(p))}) AS g,
  regexp_extract_all(c, {_sql_string(_re2(p))}) AS m, regexp_extract_all(c, {_sql_string(_re2(p))}, 1) AS a, regexp_extract_all(c, {_sql_string(_re2(p))}, 2) AS u FROM clean))"""
        for i, p in enumerate(fixed.DEADLINE_PATTERNS)
    )
    return f"""dl_raw AS ({rows}),
dl_ctx AS (SELECT *, CAST(amount AS BIGINT) AS value, CASE WHEN regexp_replace(lower(unit), 's+$', '') LIKE 'mese%' THEN 'mes' ELSE regexp_replace(lower(unit), 's+$', '') END AS un,
  lower(trim(regexp_replace(substr(c, greatest(start - 50, 0) + 1, least(start + length(whole) + 100, length(c)) - greatest(start - 50, 0)), '\\s+', ' ', 'g'))) AS ctx,
  trim(regexp_replace(whole, '\\s+', ' ', 'g')) AS context FROM dl_raw),
dl_one AS (SELECT *, row_number() OVER (PARTITION BY notice_id, value, un ORDER BY p, pos) AS dup FROM dl_ctx),
deadlines AS (SELECT notice_id, value, un AS unit, {_KIND} AS kind, context, CAST(rn - 1 AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY p, pos) AS rn FROM dl_one WHERE dup = 1))"""


@query("T9_find_deadlines", f"WITH {CLEAN_SQL}, {deadlines_sql()} SELECT * FROM deadlines")
def find_deadlines(spark, sf):
    rows = _cleaned(spark, sf).select("notice_id", ops.find_deadlines(F.col("clean")).alias("d"))
    return rows.select("notice_id", F.posexplode("d").alias("position", "x")).select(
        "notice_id", "position", "x.value", "x.unit", "x.kind", "x.context"
    )


_COUNTS = ", ".join(
    f"(SELECT count(*) FROM {t} x WHERE x.notice_id = c.notice_id) AS n_{k}"
    for k, t in [*((k, f"f_{k}") for k in ops.FINDINGS), ("deadlines", "deadlines")]
)
_WEIGHT = "CASE code " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in fixed.RISK_WEIGHTS.items()) + " END"
_ANALYSIS = f"""{CLEAN_SQL}, {', '.join(findings_sql(k) for k in ops.FINDINGS)}, {deadlines_sql()}, {_QUALITY[len(DOCS_SQL) + 2:]},
cnt AS (SELECT notice_id, c, {_COUNTS},
  coalesce((SELECT sum(w) FROM (SELECT DISTINCT code, {_WEIGHT} AS w FROM f_risks y WHERE y.notice_id = c.notice_id)), 0) AS weight,
  EXISTS (SELECT 1 FROM deadlines d WHERE d.notice_id = c.notice_id AND d.kind = 'implantacao' AND d.unit = 'dia' AND d.value < 30) AS tight FROM clean c),
risk AS (SELECT *, CAST(least(weight + CASE WHEN tight THEN 10 ELSE 0 END + CASE WHEN n_documents > 10 THEN 10 ELSE 0 END
  + CASE WHEN n_requirements > 8 THEN 10 ELSE 0 END, 100) AS DOUBLE) AS risk_score FROM cnt)"""


@query(
    "T10_doc_risk",
    f"WITH {_ANALYSIS} SELECT notice_id, risk_score, CASE WHEN risk_score >= 61 THEN 'alto' WHEN risk_score >= 31 THEN 'medio' ELSE 'baixo' END AS risk_level FROM risk WHERE length(c) >= 0",
)
def doc_risk(spark, sf):
    rows = ops.with_findings(_cleaned(spark, sf).select("notice_id", "clean"), "clean", ["documents", "requirements", "risks"])
    risk = ops.doc_risk(F.col("risks"), ops.find_deadlines(F.col("clean")), F.size("documents"), F.size("requirements"))
    return rows.select("notice_id", risk.alias("r")).select("notice_id", F.col("r.score").alias("risk_score"), F.col("r.level").alias("risk_level"))


def candidate_files(spark, sf):
    """Two candidate files per document, named after its source and language."""
    d = table(spark, sf, "documents")
    title = F.element_at(
        F.array(F.lit("Edital 1"), F.lit("Anexo II"), F.lit("Termo de Referência"), F.lit("Aviso edital")),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    first = d.select(
        F.col("doc_id").alias("notice_id"), F.concat(F.lit("https://f/"), F.col("doc_id").cast("string"), F.lit("/a")).alias("url"),
        title.alias("title"), F.when(F.col("lang") == "en", "Edital").otherwise(F.col("source")).alias("kind"),
    )
    second = d.select(
        F.col("doc_id").alias("notice_id"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("https://f/"), F.col("doc_id").cast("string"), F.lit("/b"))).alias("url"),
        F.lit("Minuta de contrato").alias("title"), F.lit("Termo de Referência").alias("kind"),
    )
    return first.union(second)


_FILES = """files AS (SELECT doc_id AS notice_id, 'https://f/' || doc_id || '/a' AS url, lower(['Edital 1', 'Anexo II', 'Termo de Referência', 'Aviso edital'][doc_id % 4 + 1]) AS name,
    lower(CASE WHEN lang = 'en' THEN 'Edital' ELSE source END) AS kind FROM documents
  UNION ALL SELECT doc_id, 'https://f/' || doc_id || '/b', 'minuta de contrato', 'termo de referência' FROM documents WHERE doc_id % 5 > 0),
fs AS (SELECT notice_id, url, CAST((CASE WHEN contains(name, 'edital') THEN 30 ELSE 0 END) + (CASE WHEN contains(name, 'termo de refer') THEN 25 ELSE 0 END)
  + (CASE WHEN contains(kind, 'edital') OR contains(kind, 'termo') THEN 20 ELSE 0 END) + 7.5
  + (CASE WHEN regexp_matches(name, 'anexo|aviso|extrato|minuta|ata|errata') THEN 0 ELSE 10 END) AS DOUBLE) AS score FROM files),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY notice_id ORDER BY score DESC, url) AS INTEGER) AS rank FROM fs)"""


@query("T12_rank_files", f"WITH {_FILES} SELECT notice_id, url, score, rank FROM fr")
def rank_files(spark, sf):
    return ops.rank_files(candidate_files(spark, sf), ["notice_id"]).select("notice_id", "url", "score", "rank")


_CONF = f"""{_ANALYSIS}, {_FILES}, conf AS (SELECT k.*, q3.quality, q3.n AS raw_n, {r(
    "(" + r("q3.quality * 30", 1) + " + coalesce(" + r("least(fr.score / 80, 1.0) * 20", 1) + ", 0) + "
    + r("((n_documents > 0)::INT + (n_requirements > 0)::INT + (n_risks > 0)::INT + (n_qualifications > 0)::INT + (n_deadlines > 0)::INT) / 5 * 20", 1) + " + "
    + r("15 * (CASE WHEN length(c) >= 10000 THEN 1.0 WHEN length(c) >= 5000 THEN 0.8 WHEN length(c) >= 2000 THEN 0.5 ELSE greatest(0.1, length(c) / 2000) END)", 1) + " + "
    + r("15 * least(len(list_filter(" + sql_list(fixed.LEGAL_TERMS) + ", lambda t: contains(lower(c), t))) / 10, 1.0)", 1) + ")", 1)} AS confidence
  FROM risk k JOIN q3 USING (notice_id) LEFT JOIN fr ON fr.notice_id = k.notice_id AND fr.rank = 1)"""
_BAND = "CASE WHEN confidence >= 70 THEN 'alta' WHEN confidence >= 40 THEN 'media' ELSE 'baixa' END"


@query("T11_doc_confidence", f"WITH {_CONF} SELECT notice_id, confidence, {_BAND} AS confidence_band FROM conf")
def doc_confidence(spark, sf):
    return analyze_documents(tender_docs(spark, sf), candidate_files(spark, sf)).select("notice_id", "confidence", "confidence_band")


@query(
    "T13_analyze_documents",
    f"""WITH {_CONF} SELECT notice_id, quality, CAST(n_documents AS INTEGER) AS documents, CAST(n_requirements AS INTEGER) AS requirements, CAST(n_risks AS INTEGER) AS risks,
  CAST(n_qualifications AS INTEGER) AS qualifications, CAST(n_deadlines AS INTEGER) AS deadlines, risk_score, confidence, {_BAND} AS confidence_band
FROM conf WHERE notice_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def analyzed_documents(spark, sf):
    done = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("notice_id"))
    rows = analyze_documents(tender_docs(spark, sf), candidate_files(spark, sf), done)
    kinds = [*ops.FINDINGS, "deadlines"]
    return rows.select("notice_id", "quality", *[F.size(k).alias(k) for k in kinds], "risk_score", "confidence", "confidence_band")
