from pyspark.sql import functions as F

from bidscope.operators import documents as ops
from bidscope.plans.documents import analyze_documents

TENDER = """EDITAL DE PREGÃO ELETRÔNICO
A empresa deverá apresentar certidão negativa de débitos FEDERAL e certidão de tributos municipal.
Atestado de capacidade técnica. Contrato social. Balanço patrimonial.
Multa de 10% sobre o valor do contrato em caso de atraso na entrega dos serviços.
Impedimento de licitar com a administração pública pelo prazo de dois anos.
Prazo de implantação: 20 (vinte) dias corridos. Prazo de vigência: 12 meses.
"""


def found(spark, text, kind, limits=None):
    return ops.with_findings(spark.createDataFrame([(text,)], "text string"), "text", [kind], limits).first()[kind]


def test_clean_text(one):
    raw = "contrata-\nção de\nserviços\x00\n\n\n\nPágina 1 de 10\n - 3 - \nFim."
    assert one(ops.clean_doc_text(F.lit(raw))) == "contratação de serviços\n\nFim."


def test_documents_found_in_accented_capitals(spark):
    codes = [f["code"] for f in found(spark, "CERTIDÃO NEGATIVA DE DÉBITOS FEDERAL", "documents")]
    assert codes == ["DOC_CERTIDAO_FEDERAL"]


def test_findings_are_distinct_and_limited(spark):
    text = ". ".join(f"alvará de funcionamento; contrato social; caução bancária {i}" for i in range(5))
    assert [f["code"] for f in found(spark, text, "documents")] == ["DOC_CONTRATO_SOCIAL", "DOC_ALVARA"]
    many = " ".join(f"Integração com o sistema de número {i} da prefeitura." for i in range(40))
    assert len(found(spark, many, "requirements")) == 40
    assert len(found(spark, many, "requirements", {"requirements": 15})) == 15


def test_deadlines(one):
    got = one(ops.find_deadlines(F.lit("Prazo de implantação: 30 (trinta) dias corridos. Em até 2 meses, pagamento.")))
    assert (got[0]["value"], got[0]["unit"], got[0]["kind"]) == (30, "dia", "implantacao")
    assert (got[1]["value"], got[1]["unit"]) == (2, "mes")


def test_risk_score(one):
    risk = lambda code: F.struct(F.lit(code).alias("code"), F.lit(code).alias("label"))
    none = F.expr("cast(array() as array<struct<value: bigint, unit: string, kind: string>>)")
    three = F.array(risk("RISCO_MULTA"), risk("RISCO_GARANTIA_CONTRATUAL"), risk("RISCO_IMPEDIMENTO_CONTRATAR"))
    got = one(ops.doc_risk(three, none, F.lit(12), F.lit(10)))
    assert (got["score"], got["level"]) == (70.0, "alto")
    got = one(ops.doc_risk(F.filter(three, lambda r: F.lit(False)), none, F.lit(3), F.lit(2)))
    assert (got["score"], got["level"]) == (0.0, "baixo")


def test_file_ranking(spark):
    files = spark.createDataFrame(
        [("n", "u1", "Anexo I", ""), ("n", "u2", "EDITAL 01", "Edital"), ("n", "", "edital", ""), ("n", "u3", "Termo de Referência", "x")],
        "notice_id string, url string, title string, kind string",
    )
    ranked = [(r["url"], r["score"]) for r in ops.rank_files(files, ["notice_id"]).orderBy("rank").collect()]
    assert ranked == [("u2", 67.5), ("u3", 42.5), ("u1", 7.5)]


def test_analysis_skips_short_and_done_documents(spark):
    docs = spark.createDataFrame([("a", TENDER), ("b", "curto"), ("c", TENDER)], "notice_id string, text string")
    done = spark.createDataFrame([("c",)], "notice_id string")
    assert {r["notice_id"] for r in analyze_documents(docs, done=done).collect()} == {"a", "b"}
    rows = analyze_documents(docs, done=done, min_chars=100).collect()
    assert [r["notice_id"] for r in rows] == ["a"]
    row = rows[0]
    assert {f["code"] for f in row["documents"]} >= {"DOC_CERTIDAO_FEDERAL", "DOC_ATESTADO_CAPACIDADE", "DOC_CONTRATO_SOCIAL"}
    # the words around the 20 days reach into the next sentence, so they count as "vigencia"
    assert [d["kind"] for d in row["deadlines"]] == ["vigencia", "vigencia"]
    assert row["risk_score"] == 15 + 20
    assert row["risk_level"] == "medio"


def test_a_pattern_runs_on_every_text_it_could_match(spark):
    texts = [
        "CERTIDÃO NEGATIVA DE débitos FEDERAL", "certıdao de tributos municipal", "MULTA de 5% sobre o valor total", "ſanção",
        "módulos de compras deve calcular tudo agora", "Treinamento", "capacitação de todos os servidores", "nada aqui",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for kind, patterns in ops.FINDINGS.items():
        for code, _, pattern in patterns:
            begins = ops.leads(pattern)
            plain = rows.select("text", F.regexp_extract_all("text", F.lit("(?iU)" + pattern), F.lit(0)).alias("m")).collect()
            for row in plain:
                got = rows.filter(F.col("text") == row["text"]).select(F.size(ops._candidates(F.col("text"), [(code, "", pattern)])).alias("n")).first()["n"] if row["m"] else 0
                assert got == len([m for m in row["m"] if len(" ".join(m.split())) > 10])
            assert begins is None or all(len(b) >= 3 for b in begins)
    assert ops.leads("a(b|c)d|xyz?w") is None
    assert ops.leads(r"(?:dever[áa]|deve)\s+x|xyzz?") == ["dever", "deve", "xyz"]
    assert ops.leads(r"(?:abcd|efgh)?ij") is None


def test_documents_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    from bidscope.checks import q_documents

    spark.range(40).selectExpr("id AS doc_id", "'No prazo de 5 dias' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert q_documents._cleaned(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
