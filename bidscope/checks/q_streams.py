"""Change detection and streams over the whole event log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bidscope.checks.q_insight import OPP_SQL, user_opportunities
from bidscope.checks.registry import query
from bidscope.checks.star import AS_OF, NOTICE_SQL, as_of, notices, table
from bidscope.session import shared_folder
from bidscope.streaming import changes, ordered


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/bidscope/{name}-{uuid.uuid4().hex}"


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _deliveries(spark, sf, folder):
    """The event log as a stream that grows by a quarter of the days at a time, not in their order."""
    events = table(spark, sf, "events")
    quarter = F.expr("pmod(datediff(ts, date '2000-01-01') div 3, 4)")
    for k in (2, 0, 3, 1):
        events.filter(quarter == k).write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(events.schema).parquet(f"{folder}/in")


def _ordered(spark, sf, observed, fields):
    """Placed and mended rows of the event log, delivered by the week; every seventh event comes a week late."""
    events, folder = table(spark, sf, "events"), _folder(spark, "ordered")
    source, part = observed(events), F.expr("datediff(ts, date '2024-01-01') div 7 + if(event_id % 7 = 0, 1, 0)")
    names = ["user_id", "ts", "event_id", fields]
    for k in range(6):
        observed(events.filter(part == k)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
        ordered.place_into(stream, *names, folder).awaitTermination()
    return ordered.mended_rows(source, spark.read.parquet(f"{folder}/placed"), *names)


_OBS = "obs AS (SELECT user_id, ts, event_id, event_type AS status, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS level FROM events)"


def _observed(events):
    return events.select(
        "user_id", "ts", "event_id", F.col("event_type").alias("status"), F.floor(F.col("value") / 10).cast("string").alias("level")
    )


_HISTORY = f"""WITH {_OBS}, l AS (SELECT *, lag(status) OVER w AS ps, lag(level) OVER w AS pl FROM obs WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, 'status' AS field, ps AS old_value, status AS new_value FROM l WHERE ps IS NULL OR ps <> status
UNION ALL SELECT user_id, event_id, 'level', pl, level FROM l WHERE pl IS NULL OR pl <> level"""


@query("C1_detect_changes", _HISTORY)
def change_history(spark, sf):
    rows = changes.change_history(_observed(table(spark, sf, "events")), "user_id", "ts", "event_id", ["status", "level"])
    return rows.select("user_id", "event_id", "field", "old_value", "new_value")


@query("C1_detect_changes_stream", _HISTORY)
def change_stream(spark, sf):
    folder = _folder(spark, "changes")
    stream = _observed(_event_stream(spark, sf))
    changes.stream_changes(stream, "user_id", "ts", "event_id", ["status", "level"], folder).awaitTermination()
    return changes.alerts_so_far(spark, folder).select("user_id", "event_id", "field", "old_value", "new_value")


@query("C1_detect_changes_ordered", _HISTORY)
def ordered_change_stream(spark, sf):
    rows = _ordered(spark, sf, _observed, ["status", "level"])
    alerts = changes.alerts_of(rows, "user_id", "ts", "event_id", ["status", "level"])
    return alerts.select("user_id", "event_id", "field", "old_value", "new_value")


@query(
    "C1_snapshot_alerts",
    f"""WITH {NOTICE_SQL}, w AS (SELECT *, CASE WHEN status = 'P' THEN 'O' WHEN modality_id = 5 THEN '' ELSE status END AS ls, CASE WHEN small_business THEN estimate ELSE estimate + 1 END AS le FROM notice)
SELECT notice_id, 'status' AS field, NULLIF(ls, '') AS old_value, status AS new_value FROM w WHERE ls <> status AND modality_id <> 4
UNION ALL SELECT notice_id, 'modality', NULL, modality FROM w WHERE modality_id <> 4""",
)
def snapshot_alerts(spark, sf):
    n = notices(spark, sf)
    last = F.when(F.col("status") == "P", "O").when(F.col("modality_id") == 5, "").otherwise(F.col("status"))
    watches = n.select(
        F.col("notice_id").alias("watch_id"), "notice_id", (F.col("modality_id") != 4).alias("active"),
        last.alias("last_status"), F.lit(None).cast("string").alias("last_modality"),
    )
    rows = changes.detect_changes(watches, n, ["status", "modality"])
    return rows.select("notice_id", "field", "old_value", "new_value")


_WATCHED = ["status", "estimate", "awarded", "closes_at"]
_WATCH_SQL = f"""{NOTICE_SQL}, w AS (SELECT notice_id, modality_id <> 4 AS active, status, CAST(CAST(floor(estimate) AS BIGINT) AS VARCHAR) AS estimate,
  CASE WHEN modality_id = 1 THEN '' ELSE CAST(CAST(floor(awarded) AS BIGINT) AS VARCHAR) END AS awarded, CAST(CAST(closes_at AS DATE) AS VARCHAR) AS closes_at,
  CASE WHEN status = 'P' THEN 'O' ELSE status END AS last_status, CASE WHEN modality_id = 2 THEN '1' ELSE CAST(CAST(floor(estimate) AS BIGINT) AS VARCHAR) END AS last_estimate,
  CASE WHEN modality_id <> 3 THEN '0' END AS last_awarded, CAST(CAST(published_at AS DATE) + (CASE WHEN modality_id = 5 THEN 31 ELSE 30 END) AS VARCHAR) AS last_closes_at FROM notice)"""


def _watched(spark, sf):
    """Watches of all notices, and the notices with the four watched fields as they are now."""
    n = notices(spark, sf)
    amount = lambda c: F.floor(c).cast("long").cast("string")
    day = lambda c: F.col(c).cast("date")
    kind = F.col("modality_id")
    current = n.select(
        "notice_id", "status", amount("estimate").alias("estimate"), F.when(kind == 1, "").otherwise(amount("awarded")).alias("awarded"),
        day("closes_at").cast("string").alias("closes_at"),
    )
    watches = n.select(
        "notice_id", F.col("notice_id").alias("watch_id"), (kind != 4).alias("active"), F.when(F.col("status") == "P", "O").otherwise(F.col("status")).alias("last_status"),
        F.when(kind == 2, "1").otherwise(amount("estimate")).alias("last_estimate"), F.when(kind != 3, "0").alias("last_awarded"),
        F.date_add(day("published_at"), F.when(kind == 5, 31).otherwise(30)).cast("string").alias("last_closes_at"),
    )
    return watches, current


@query(
    "C1_watched_fields",
    f"WITH {_WATCH_SQL} "
    + " UNION ALL ".join(
        f"SELECT notice_id, '{f}' AS field, last_{f} AS old_value, {f} AS new_value FROM w WHERE active AND {f} <> '' AND {f} <> coalesce(last_{f}, '')" for f in _WATCHED
    ),
)
def watched_fields(spark, sf):
    return changes.detect_changes(*_watched(spark, sf), _WATCHED).select("notice_id", "field", "old_value", "new_value")


@query(
    "C1_updated_snapshots",
    f"WITH {_WATCH_SQL} SELECT notice_id, "
    + ", ".join(f"CASE WHEN active AND {f} <> '' THEN {f} ELSE last_{f} END AS last_{f}" for f in _WATCHED) + " FROM w",
)
def updated_snapshots(spark, sf):
    return changes.updated_snapshots(*_watched(spark, sf), _WATCHED).select("notice_id", *[f"last_{f}" for f in _WATCHED])


@query(
    "C2_open_flag_change",
    """WITH f AS (SELECT user_id, ts, event_id, TIMESTAMP '2024-01-15' + INTERVAL (CAST(floor(value) AS BIGINT)) HOUR > ts AS flag FROM events),
l AS (SELECT *, lag(flag) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM f)
SELECT user_id, event_id, p AS old_value, flag AS new_value FROM l WHERE p IS NULL OR p <> flag""",
)
def open_flag_change(spark, sf):
    events = table(spark, sf, "events")
    ends = F.lit("2024-01-15").cast("timestamp") + F.make_dt_interval(hours=F.floor("value").cast("int"))
    rows = changes.open_flag_changes(events.withColumn("closes_at", ends), "user_id", "ts", "event_id", "closes_at")
    return rows.select("user_id", "event_id", "old_value", "new_value")


_ALERTS = f"""{NOTICE_SQL}, {OPP_SQL}, d AS (SELECT opportunity_id, user_id, notice_id, 'prazo_interno' AS kind, internal_due AS due, status FROM opp
  UNION ALL SELECT opportunity_id, user_id, notice_id, 'encerramento_proposta', CAST(closes_at AS DATE), status FROM opp),
a AS (SELECT *, CAST(due - DATE '{AS_OF}' AS INTEGER) AS days_left FROM d WHERE status NOT IN ('ganha', 'perdida', 'descartada'))"""


@query(
    "C3_deadline_alerts",
    f"WITH {_ALERTS} SELECT opportunity_id, user_id, kind, days_left FROM a WHERE days_left IN (3, 1, 0) AND NOT (kind = 'prazo_interno' AND days_left = 3)",
)
def deadline_alerts(spark, sf):
    today = as_of().cast("date")
    opps = user_opportunities(spark, sf)
    sent = changes.deadline_alerts(opps, today).filter("kind = 'prazo_interno' AND days_left = 3")
    rows = changes.deadline_alerts(opps, today, sent)
    return rows.select("opportunity_id", "user_id", "kind", "days_left")


@query(
    "C3_deadline_alerts_stream",
    f"""WITH {_ALERTS} SELECT DISTINCT opportunity_id, user_id, kind, k AS days_left FROM d, (VALUES (3), (1), (0)) AS t(k)
WHERE status NOT IN ('ganha', 'perdida', 'descartada') AND CAST(due AS DATE) - CAST(k AS INTEGER) IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""",
)
def deadline_alert_stream(spark, sf):
    """A run on every day with orders, in four deliveries; each repeats the last days of the one before."""
    folder, opps = _folder(spark, "deadlines"), user_opportunities(spark, sf)
    runs = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    for year in (1995, 1997, 1999, 2001):
        delivered = f"day >= make_date({year}, 1, 1) - interval 5 days and day < make_date({year + 2}, 1, 1)"
        runs.filter(delivered if year > 1995 else "day < date '1997-01-01'").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(runs.schema).parquet(f"{folder}/in")
        changes.run_once(changes.deadline_alert_stream(stream, "day", opps), f"{folder}/sent", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/sent").select("opportunity_id", "user_id", "kind", "days_left")


_STATUS_CHANGES = """WITH l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, event_id, p AS old_status, event_type AS new_status FROM l WHERE p IS NOT NULL AND p <> event_type"""


@query("C4_status_history", _STATUS_CHANGES)
def status_history(spark, sf):
    rows = changes.status_history(table(spark, sf, "events"), "user_id", "ts", "event_id", "event_type")
    return rows.select("user_id", "event_id", "old_status", "new_status")


@query("C4_status_history_stream", _STATUS_CHANGES)
def status_history_stream(spark, sf):
    rows = _ordered(spark, sf, lambda events: events.select("user_id", "ts", "event_id", "event_type"), ["event_type"])
    return changes.status_changes(rows, "user_id", "ts", "event_id", "event_type").select("user_id", "event_id", "old_status", "new_status")


@query(
    "C5_config_change_flag",
    "SELECT r_regionkey AS org_id, r_regionkey IN (0, 2) AS pending, CASE WHEN r_regionkey IN (0, 2) THEN TIMESTAMP '2001-08-01' END AS changed_at FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)",
)
def config_change_flag(spark, sf):
    from bidscope.checks.q_prospect import org_configs

    new = org_configs(spark, sf)
    old = new.withColumns({
        "keywords": F.when(F.col("org_id") == 0, F.array(F.lit("x"))).otherwise(F.col("keywords")),
        "microregions": F.when(F.col("org_id") == 2, F.lit(None)).otherwise(F.col("microregions")),
    })
    return changes.config_change_flags(old, new, as_of()).select("org_id", "pending", "changed_at")


@query("C6_alert_feed", "SELECT event_type, count(*) AS alerts FROM events GROUP BY event_type")
def alert_feed(spark, sf):
    folder = _folder(spark, "feed")
    table(spark, sf, "events").write.parquet(f"{folder}/alerts")
    feed = changes.alert_feed(spark, f"{folder}/alerts", table(spark, sf, "events").schema)
    changes.run_once(feed.select("event_id", "event_type"), f"{folder}/seen", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/seen").groupBy("event_type").agg(F.count(F.lit(1)).alias("alerts"))


@query("C7_incremental_collect", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def incremental_collect(spark, sf):
    """All events in four deliveries out of order, so that later ones lie far behind the newest row seen."""
    folder, keys = _folder(spark, "collect"), ["user_id", "event_type", "day"]
    for stream in _deliveries(spark, sf, folder):
        changes.collect_into(stream.withColumn("day", F.col("ts").cast("date")), "ts", keys, folder).awaitTermination()
    return changes.collected(spark, folder, "ts", keys).select(*keys)


@query(
    "C8_scrape_log",
    """SELECT CAST(user_id AS VARCHAR) AS ibge_code, CAST(ts AS DATE) AS run_id, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'error' ELSE 'success' END AS status,
  count(*) FILTER (event_type <> 'error') AS found FROM events GROUP BY ALL""",
)
def scrape_log(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("ibge_code"), F.col("ts").cast("date").alias("run_id"), F.col("ts").alias("ended_at"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
    )
    return changes.scrape_log_rows(runs).select("ibge_code", "run_id", "status", "found")


@query("C9_collection_by_day", f"WITH {NOTICE_SQL} SELECT CAST(published_at AS DATE) AS day, state, source, count(*) AS rows_n FROM notice GROUP BY ALL")
def collection_by_day(spark, sf):
    return changes.collection_by_day(notices(spark, sf), "published_at", ["state", "source"])


@query("C9_collection_by_day_stream", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS rows_n FROM events GROUP BY ALL")
def collection_by_day_stream(spark, sf):
    folder = _folder(spark, "days")
    for stream in _deliveries(spark, sf, folder):
        changes.count_days_into(stream, "ts", ["event_type"], folder).awaitTermination()
    return changes.days_so_far(spark, folder, ["event_type"])
