"""Landed notice, item and award payloads turned into table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from bidscope.functions import fixed_values as fixed
from bidscope.functions.keys import notice_hash
from bidscope.functions.literals import code_name_map
from bidscope.functions.parsing import notice_url

NOTICE_PAYLOAD = """
orgaoEntidade STRUCT<cnpj STRING, razaoSocial STRING, codigoMunicipioIbge STRING>,
unidadeOrgao STRUCT<codigoIbge STRING, ufSigla STRING, municipioNome STRING>,
amparoLegal STRUCT<codigo INT, descricao STRING>,
anoCompra INT, sequencialCompra INT, objetoCompra STRING, informacaoComplementar STRING,
modalidadeId INT, modoDisputaId INT, situacaoCompraId INT, situacaoCompraNome STRING,
tipoBeneficioId INT, valorTotalEstimado DOUBLE, valorTotalHomologado DOUBLE,
dataPublicacaoPncp STRING, dataAberturaProposta STRING, dataEncerramentoProposta STRING,
srp BOOLEAN, processo STRING, numeroControlePNCP STRING, linkSistemaOrigem STRING,
tipoInstrumentoConvocatorioNome STRING, dataAtualizacao STRING
"""


def read_notice_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Notice payloads of JSON files, one document per line."""
    return spark.read.schema(NOTICE_PAYLOAD).json(path)


def stream_notice_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of newly landed files."""
    return spark.readStream.schema(NOTICE_PAYLOAD).json(path)


def read_payload_pages(spark: SparkSession, path: str) -> DataFrame:
    """Payloads landed as whole result pages: {"data": [notice, ...]} per file."""
    notice = T.StructType.fromDDL(NOTICE_PAYLOAD)
    schema = T.StructType([T.StructField("data", T.ArrayType(notice))])
    pages = spark.read.schema(schema).json(path, multiLine=True)
    return pages.select(F.explode("data").alias("n")).select("n.*")


def parse_payloads(rows: DataFrame, column: str) -> DataFrame:
    """Adds the payload fields of a JSON text column.

    The generator makes every row parsed once, however many fields and filters follow.
    """
    return rows.select("*", F.inline_outer(F.array(F.from_json(column, NOTICE_PAYLOAD))))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unit_ibge_code() -> Column:
    """Municipality of the buying unit, else of the organisation."""
    return F.coalesce(
        F.nullif("unidadeOrgao.codigoIbge", F.lit("")),
        F.nullif("orgaoEntidade.codigoMunicipioIbge", F.lit("")),
        F.lit(""),
    )


def modality_name(modality_id: Column) -> Column:
    names = code_name_map(fixed.MODALITY_NAMES)
    return F.coalesce(F.element_at(names, modality_id), modality_id.cast("string"), F.lit(""))


def flatten_notice(payloads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Payload rows as notice rows; ``keep`` names extra input columns to carry along.

    Expects the municipality columns municipality, state and ibge_code to be joined already.
    """
    keep = keep or []
    benefit = F.coalesce("tipoBeneficioId", F.lit(0))
    return payloads.select(
        *keep,
        "municipality",
        "state",
        _text("ibge_code").alias("ibge_code"),
        _text("orgaoEntidade.razaoSocial").alias("org_name"),
        _text("orgaoEntidade.cnpj").alias("org_tax_id"),
        _text("objetoCompra").alias("subject"),
        benefit.isin(fixed.SMALL_BUSINESS_BENEFITS).alias("small_business"),
        modality_name(F.col("modalidadeId")).alias("modality"),
        F.coalesce("valorTotalEstimado", F.lit(0.0)).alias("estimate"),
        F.coalesce("valorTotalHomologado", F.lit(0.0)).alias("awarded"),
        _text("situacaoCompraNome").alias("status"),
        _text("dataPublicacaoPncp").alias("published_at"),
        _text("dataAberturaProposta").alias("opens_at"),
        _text("dataEncerramentoProposta").alias("closes_at"),
        notice_url(F.col("orgaoEntidade.cnpj"), F.col("anoCompra"), F.col("sequencialCompra")).alias("url"),
        F.lit("PNCP").alias("source"),
        _text("anoCompra").alias("year"),
        _text("sequencialCompra").alias("sequence"),
        _text("informacaoComplementar").alias("extra_info"),
        F.col("modalidadeId").alias("modality_id"),
        F.col("modoDisputaId").alias("dispute_mode_id"),
        F.col("situacaoCompraId").alias("status_id"),
        F.coalesce("srp", F.lit(False)).alias("price_register"),
        _text("numeroControlePNCP").alias("control_number"),
        _text("amparoLegal.codigo").alias("legal_basis_code"),
        _text("amparoLegal.descricao").alias("legal_basis"),
        _text("processo").alias("process_number"),
        _text("linkSistemaOrigem").alias("origin_link"),
        _text("tipoInstrumentoConvocatorioNome").alias("instrument"),
        _text("dataAtualizacao").alias("updated_at"),
        F.to_json(F.struct(*T.StructType.fromDDL(NOTICE_PAYLOAD).names)).alias("raw"),
    )


def extract_from_raw(notices: DataFrame) -> DataFrame:
    """Fill missing modality, dispute mode and status ids from the retained payload."""
    fields = {
        "modality_id": "$.modalidadeId",
        "dispute_mode_id": "$.modoDisputaId",
        "status_id": "$.situacaoCompraId",
    }
    eligible = (F.col("source") == "PNCP") & F.col("modality_id").isNull()
    filled = {
        name: F.when(
            eligible, F.coalesce(F.get_json_object("raw", path).try_cast("int"), F.col(name))
        ).otherwise(F.col(name))
        for name, path in fields.items()
    }
    return notices.withColumns(filled)


# ---------------------------------------------------------------- items and awards


def _blank_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in columns})


def _strings(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def check_items(items: DataFrame) -> DataFrame:
    """Cleaned item payloads with ``reject_reason`` (null = valid)."""
    number = F.trim("numeroItem").try_cast("int")
    clean = _blank_to_null(items.withColumn("_number", number), _strings(items))
    amounts = {c: F.col(c).try_cast("double") for c in ("quantidade", "valorUnitarioEstimado", "valorTotal")}
    reason = (
        F.when(F.col("numeroItem").isNull(), "missing number")
        .when(F.col("_number").isNull(), "number not an integer")
        .when(F.col("_number") <= 0, "number not positive")
    )
    return (
        clean.withColumn("reject_reason", reason)
        .withColumns(amounts)
        .withColumn("numeroItem", F.col("_number"))
        .drop("_number")
    )


def clean_items(items: DataFrame) -> DataFrame:
    return check_items(items).filter("reject_reason IS NULL").drop("reject_reason")


def check_awards(awards: DataFrame) -> DataFrame:
    """Cleaned award payloads with ``reject_reason`` (null = valid)."""
    money = ("valorUnitarioHomologado", "valorTotalHomologado", "quantidadeHomologada")
    sequence = F.trim("sequencialResultado").try_cast("int")
    clean = _blank_to_null(awards.withColumn("_sequence", sequence), _strings(awards))
    clean = clean.withColumns({c: F.col(c).try_cast("double") for c in (*money, "percentualDesconto")})
    negative = F.coalesce(F.least(*[F.coalesce(F.col(c), F.lit(0.0)) for c in money]) < 0, F.lit(False))
    reason = (
        F.when(F.col("sequencialResultado").isNull(), "missing sequence")
        .when(F.col("_sequence").isNull(), "sequence not an integer")
        .when(negative, "negative amount")
    )
    return (
        clean.withColumn("reject_reason", reason)
        .withColumn("sequencialResultado", F.col("_sequence"))
        .drop("_sequence")
    )


def clean_awards(awards: DataFrame) -> DataFrame:
    return check_awards(awards).filter("reject_reason IS NULL").drop("reject_reason")


def build_item_rows(items: DataFrame, collected_at: Column, version: str = "v1") -> DataFrame:
    """Clean item payloads with their notice metadata as item rows.

    Metadata columns expected: org_tax_id, year, sequence, notice_hash, platform_id, platform,
    state, municipality, ibge_code, modality_id.
    """
    identity = notice_hash(F.lit("PNCP"), F.col("org_tax_id"), F.col("year"), F.col("sequence"))
    return items.select(
        F.coalesce("notice_hash", identity).alias("notice_hash"),
        "org_tax_id",
        "year",
        "sequence",
        F.col("numeroItem").alias("item_no"),
        F.col("descricao").alias("description"),
        F.col("ncmNbsCodigo").alias("code"),
        F.col("quantidade").alias("quantity"),
        F.col("unidadeMedida").alias("unit"),
        F.col("valorUnitarioEstimado").alias("estimate"),
        F.col("valorTotal").alias("total_estimate"),
        F.coalesce("temResultado", F.lit(False)).alias("has_award"),
        "platform_id",
        "platform",
        "state",
        "municipality",
        "ibge_code",
        "modality_id",
        F.col("materialOuServico").alias("material_or_service"),
        F.col("tipoBeneficio").alias("benefit_id"),
        F.col("criterioJulgamentoId").alias("criterion_id"),
        collected_at.alias("collected_at"),
        F.lit(version).alias("collector_version"),
    )


def build_award_rows(awards: DataFrame, collected_at: Column, version: str = "v1") -> DataFrame:
    return awards.select(
        "item_id",
        F.col("sequencialResultado").alias("award_seq"),
        F.col("valorUnitarioHomologado").alias("unit_award"),
        F.col("valorTotalHomologado").alias("total_award"),
        F.col("quantidadeHomologada").alias("quantity"),
        F.col("percentualDesconto").alias("discount"),
        F.col("niFornecedor").alias("supplier_id"),
        F.col("nomeRazaoSocialFornecedor").alias("supplier_name"),
        F.col("porteFornecedorNome").alias("supplier_size"),
        F.col("dataResultado").alias("awarded_at"),
        collected_at.alias("collected_at"),
        F.lit(version).alias("collector_version"),
    )


def collection_metrics(checked: DataFrame, keys: list[str], persisted: Column) -> DataFrame:
    """Returned, valid, dropped and persisted counts per key, and drops by reason."""
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("returned"),
        F.count_if(F.col("reject_reason").isNull()).alias("valid"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("dropped"),
        F.count_if(F.col("reject_reason").isNull() & persisted).alias("persisted"),
    )


def failures_by_class(checked: DataFrame) -> DataFrame:
    return (
        checked.filter("reject_reason IS NOT NULL")
        .groupBy("reject_reason")
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def observe_collection(checked: DataFrame, persisted: Column, reasons: list[str]) -> tuple[DataFrame, Observation]:
    """The checked rows, whose counts in total and by reason are gathered while they pass.

    The counts cost no pass of their own: ``Observation.get`` holds them once an action, such as the write of the
    rows, has run. They count the rows of that action's first run.
    """
    valid = F.col("reject_reason").isNull()
    counts = {"returned": F.lit(True), "valid": valid, "dropped": ~valid, "persisted": valid & persisted}
    counts |= {reason: F.col("reject_reason") == reason for reason in reasons}
    seen = Observation()
    return checked.observe(seen, *[F.count_if(test).alias(name) for name, test in counts.items()]), seen
