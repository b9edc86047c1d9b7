import datetime as dt
import json
import random

from pyspark.sql import functions as F

from bidscope.sources import feeds, payloads
from bidscope.streaming import changes


def test_payload_files_and_flattening(spark, tmp_path):
    notice = {
        "orgaoEntidade": {"cnpj": "123", "razaoSocial": "Prefeitura"}, "anoCompra": 2026, "sequencialCompra": 7,
        "objetoCompra": "Software", "modalidadeId": 6, "tipoBeneficioId": 1, "valorTotalEstimado": None,
    }
    (tmp_path / "a.json").write_text(json.dumps(notice) + "\n" + json.dumps({"objetoCompra": "x"}) + "\n")
    rows = payloads.read_notice_payloads(spark, str(tmp_path)).withColumns(
        {"municipality": F.lit("M"), "state": F.lit("MG"), "ibge_code": F.lit("1")}
    )
    got = {r["subject"]: r for r in payloads.flatten_notice(rows).collect()}
    full, bare = got["Software"], got["x"]
    assert full["url"] == "https://pncp.gov.br/app/editais/123/2026/7" and bare["url"] == ""
    assert full["modality"] == "Pregão Eletrônico" and bare["modality"] == ""
    assert full["small_business"] and not bare["small_business"]
    assert full["estimate"] == 0.0
    assert json.loads(full["raw"])["anoCompra"] == 2026

    page = tmp_path / "pages"
    page.mkdir()
    (page / "p.json").write_text(json.dumps({"data": [notice, notice]}))
    assert payloads.read_payload_pages(spark, str(page)).count() == 2


def test_item_and_award_cleaning(spark):
    items = spark.createDataFrame(
        [(None, "a"), ("0", "a"), ("-1", "a"), ("abc", "a"), ("5", "  ")], "numeroItem string, descricao string"
    ).withColumns({c: F.lit("n/d") for c in ("quantidade", "valorUnitarioEstimado", "valorTotal")})
    rows = payloads.clean_items(items).collect()
    assert [(r["numeroItem"], r["descricao"], r["quantidade"]) for r in rows] == [(5, None, None)]
    awards = spark.createDataFrame(
        [("1", "-10"), ("2", "10"), ("x", "1")], "sequencialResultado string, valorUnitarioHomologado string"
    ).withColumns({c: F.lit(None).cast("string") for c in ("valorTotalHomologado", "quantidadeHomologada", "percentualDesconto")})
    assert [r["sequencialResultado"] for r in payloads.clean_awards(awards).collect()] == [2]


PAGE = """<html><body><table><tr><th>Nº Processo</th><th>Objeto</th><th>Data</th><th>Valor</th></tr>
<tr><td>047/2025</td><td><a href="/edital/47">Reforma da quadra da escola rural</a></td><td>17/09/2025</td><td>R$ 83.214,60</td></tr>
<tr><td>048/2025</td><td>Pregão eletrônico de merenda escolar</td><td>22/10/2025</td><td></td></tr></table></body></html>"""
CARDS = """<div class="card-licitacao"><h3>Pregão presencial nº 12/2026</h3><p>Valor R$ 1.000,50 em 05/04/2026</p></div>
<div class="outro">nada aqui que interesse a ninguém</div>"""
HEADINGS = "<h2>Licitação para compra de veículos 03/04/2026</h2><h2>Notícias</h2>"


def test_portal_pages(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.br/x", PAGE), (2, "https://a.br/x", CARDS), (3, "https://a.br/x", HEADINGS)], "page int, url string, html string"
    )
    rows = feeds.portal_pages_to_notice(pages, "page").orderBy("page", "published_at").collect()
    assert [(r["page"], r["published_at"]) for r in rows] == [
        (1, "2025-09-17T00:00:00"), (1, "2025-10-22T00:00:00"), (2, "2026-04-05T00:00:00"), (3, "2026-04-03T00:00:00"),
    ]
    first = rows[0]
    assert (first["process_number"], first["estimate"], first["url"]) == ("047/2025", 83214.6, "https://a.br/edital/47")
    assert rows[1]["modality"] == "Pregão Eletrônico"
    assert (rows[2]["process_number"], rows[2]["estimate"], rows[2]["modality"]) == ("12/2026", 1000.5, "Pregão Presencial")
    in_range = feeds.portal_pages_to_notice(pages, "page", "2025-10-01", "2026-04-03")
    assert in_range.count() == 2


def observations(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 7, start + dt.timedelta(hours=5 * i), i, "abc"[i * i % 3], str(i // 40)) for i in range(200)]
    return spark.createDataFrame(rows, "k int, t timestamp, i int, status string, level string")


def test_stream_of_many_batches_equals_the_batch_job(spark, tmp_path):
    rows = observations(spark)
    source = tmp_path / "in"
    for part in range(4):
        rows.filter((F.col("i") >= part * 50) & (F.col("i") < part * 50 + 50)).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    folder = str(tmp_path / "out")
    changes.stream_changes(stream, "k", "t", "i", ["status", "level"], folder).awaitTermination()
    key = lambda r: (r["k"], r["i"], r["field"], r["old_value"] or "", r["new_value"])
    streamed = sorted(map(key, changes.alerts_so_far(spark, folder).collect()))
    batch = sorted(map(key, changes.change_history(rows, "k", "t", "i", ["status", "level"]).collect()))
    assert streamed == batch


def test_rows_older_than_the_last_seen_are_kept_apart(spark, tmp_path):
    at = lambda hour: dt.datetime(2024, 1, 1, hour)
    source = tmp_path / "in"
    parts = [[(1, at(10), 1, "x"), (None, at(9), 2, "a")], [(1, at(5), 3, "y"), (1, at(12), 4, "z"), (None, at(11), 5, "b")]]
    for part in parts:
        spark.createDataFrame(part, "k int, t timestamp, i int, status string").coalesce(1).write.mode("append").parquet(str(source))
    schema = "k int, t timestamp, i int, status string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    folder = str(tmp_path / "out")
    changes.stream_changes(stream, "k", "t", "i", ["status"], folder).awaitTermination()
    late = spark.read.parquet(f"{folder}/late/batch=1")
    assert [tuple(r) for r in late.collect()] == [(1, at(5), 3, "y")]
    alerts = {(r["k"], r["i"], r["old_value"] or "", r["new_value"]) for r in changes.alerts_so_far(spark, folder).collect()}
    assert {(1, 4, "x", "z"), (None, 5, "a", "b")} <= alerts and all(i != 3 for _, i, _, _ in alerts)


def test_deadline_alerts(spark):
    day = dt.date(2026, 1, 10)
    rows = [("o1", day + dt.timedelta(3), None, "analisando"), ("o2", day + dt.timedelta(2), None, "analisando"),
            ("o3", day, dt.datetime(2026, 1, 11, 8), "analisando"), ("o4", day, None, "ganha")]
    opps = spark.createDataFrame(
        [(o, "u", "n", s, d, c) for o, d, c, s in rows],
        "opportunity_id string, user_id string, notice_id string, status string, internal_due date, closes_at timestamp",
    )
    first = changes.deadline_alerts(opps, F.lit(day))
    got = sorted((r["opportunity_id"], r["kind"], r["days_left"]) for r in first.collect())
    assert got == [("o1", "prazo_interno", 3), ("o3", "encerramento_proposta", 1), ("o3", "prazo_interno", 0)]
    assert changes.deadline_alerts(opps, F.lit(day), first).count() == 0


def test_first_snapshot_alerts_with_empty_old_value(spark):
    watches = spark.createDataFrame([(1, 1, True, None), (2, 2, False, None)], "watch_id int, notice_id int, active boolean, last_status string")
    current = spark.createDataFrame([(1, " aberta "), (2, "x")], "notice_id int, status string")
    rows = changes.detect_changes(watches, current, ["status"]).collect()
    assert [(r["watch_id"], r["old_value"], r["new_value"]) for r in rows] == [(1, None, "aberta")]
    moved = changes.updated_snapshots(watches, current, ["status"])
    assert changes.detect_changes(moved, current, ["status"]).count() == 0


def test_streams_over_late_files_equal_the_batch(spark, tmp_path):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(6), start + dt.timedelta(hours=rng.randrange(24 * 20)), k) for k in range(300)]
    schema, keys, folder = "user int, at timestamp, k int", ["user", "day"], str(tmp_path)
    days = {k: (at - start).days // 5 for _, at, k in rows}
    day = F.col("at").cast("date")
    for part in (3, 0, 1, 2, 9):  # the last one delivers nothing new
        again = [r for r in rows if days[r[2]] == part or (part == 9 and r[2] % 7 == 0)]
        spark.createDataFrame(again, schema).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        changes.collect_into(stream.withColumn("day", day), "at", keys, f"{folder}/c").awaitTermination()
        if part != 9:
            changes.count_days_into(stream, "at", ["user"], f"{folder}/d").awaitTermination()
    got = sorted((r["user"], r["at"]) for r in changes.collected(spark, f"{folder}/c", "at", keys).collect())
    first = {}
    for user, at, _ in rows:
        first[user, at.date()] = min(at, first.get((user, at.date()), at))
    assert got == sorted((user, at) for (user, _), at in first.items())
    assert spark.read.parquet(f"{folder}/c/late").count() > 100
    counts = {(r["user"], r["day"]): r["rows_n"] for r in changes.days_so_far(spark, f"{folder}/d", ["user"]).collect()}
    want = {}
    for user, at, _ in rows:
        want[user, at.date()] = want.get((user, at.date()), 0) + 1
    assert counts == want
    written = spark.read.parquet(f"{folder}/d/counts").groupBy("batch").agg(F.sum("rows_n").alias("n")).collect()
    assert sum(r["n"] for r in written) == len(rows) and len(written) >= 4


def test_counts_are_gathered_while_rows_are_written(spark, tmp_path):
    rows = [(k, [None, "bad", "worse"][k % 3] if k % 2 else None) for k in range(50)]
    checked = spark.createDataFrame(rows, "k int, reject_reason string").repartition(4)
    seen_rows, seen = payloads.observe_collection(checked, F.col("k") < 10, ["bad", "worse", "none"])
    seen_rows.filter("reject_reason is null").write.parquet(str(tmp_path / "out"))
    reasons = [r for _, r in rows]
    valid = reasons.count(None)
    want = {"returned": 50, "valid": valid, "dropped": 50 - valid, "persisted": sum(r is None for r in reasons[:10])}
    assert seen.get == want | {"bad": reasons.count("bad"), "worse": reasons.count("worse"), "none": 0}
    empty, none = payloads.observe_collection(checked.filter("false"), F.lit(True), ["bad"])
    empty.write.parquet(str(tmp_path / "none"))
    assert set(none.get.values()) == {0}


def test_pages_of_one_file_are_dealt_over_all_cores(spark, tmp_path):
    html = "<html><body><h2>Licitação de material de escritório n. 1/2024</h2></body></html>"
    spark.createDataFrame([(i, "https://x.org/a", html) for i in range(40)], "page_id int, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    rows = feeds.portal_pages_to_notice(spark.read.parquet(f"{tmp_path}/pages"), "page_id")
    assert "REPARTITION_BY_COL" in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["page_id"] for r in rows.collect()) == list(range(40))
