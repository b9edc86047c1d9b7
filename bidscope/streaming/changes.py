"""Change detection, deadline alerts and incremental collection, as batch jobs and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from bidscope.functions import fixed_values as fixed
from bidscope.functions.parsing import is_open
from bidscope.operators.skew import first_per_key, previous_values
from bidscope.operators.tables import insert_ignore
from bidscope.plans.prospect import changed_configs


def _shown(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def _alerts(rows: DataFrame, keep: list[str], fields: list[str], old: str = "previous_") -> DataFrame:
    """One row per field whose new non-empty text differs from the old one."""
    entries = F.array(*[
        F.struct(
            F.lit(f).alias("field"),
            F.nullif(_shown(F.col(old + f)), F.lit("")).alias("old_value"),
            _shown(F.col(f)).alias("new_value"),
        )
        for f in fields
    ])
    listed = rows.select(*keep, F.inline(entries))
    changed = (F.col("new_value") != "") & (F.col("new_value") != F.coalesce("old_value", F.lit("")))
    return listed.filter(changed)


def detect_changes(watches: DataFrame, current: DataFrame, fields: list[str], keep: list[str] | None = None) -> DataFrame:
    """Alerts of active watches whose notice differs from the last snapshot.

    watches: watch_id, notice_id, active, last_<field>; current: notice_id and the fields.
    """
    keep = keep or []
    rows = watches.filter("active").join(current.select("notice_id", *fields), "notice_id")
    return _alerts(rows, ["watch_id", "notice_id", *keep], fields, old="last_")


def updated_snapshots(watches: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """Watches with their snapshot moved to the current non-empty values."""
    now = current.select("notice_id", *[F.col(f).alias(f"_now_{f}") for f in fields])
    rows = watches.join(now, "notice_id", "left")
    moved = {
        f"last_{f}": F.when(
            F.col("active") & (_shown(F.col(f"_now_{f}")) != ""), F.col(f"_now_{f}")
        ).otherwise(F.col(f"last_{f}"))
        for f in fields
    }
    return rows.withColumns(moved).select(*watches.columns)


def change_history(
    observations: DataFrame, key: str, time: str, tie: str, fields: list[str], bucket: str = "day"
) -> DataFrame:
    """Alerts of a whole log of observations: each against the one before it of the same key.

    The first observation of a key alerts with an empty old value.
    """
    rows = previous_values(observations, [key], F.date_trunc(bucket, F.col(time)), [time, tie], fields)
    return alerts_of(rows, key, time, tie, fields)


def alerts_of(rows: DataFrame, key: str, time: str, tie: str, fields: list[str]) -> DataFrame:
    """Alerts of rows that stand beside their previous values, from a batch or a stream of placed rows."""
    return _alerts(rows, [key, time, tie], fields)


def open_flag_changes(observations: DataFrame, key: str, time: str, tie: str, closes_at: str) -> DataFrame:
    """Changes of the computed open flag: at each observation, is the end still ahead."""
    flagged = observations.withColumn("open_flag", is_open(F.col(closes_at), F.col(time)))
    rows = previous_values(flagged, [key], F.date_trunc("day", F.col(time)), [time, tie], ["open_flag"])
    changed = F.col("open_flag") != F.coalesce("previous_open_flag", ~F.col("open_flag"))
    return rows.filter(changed).select(key, time, tie, F.col("previous_open_flag").alias("old_value"), F.col("open_flag").alias("new_value"))


def status_history(updates: DataFrame, key: str, time: str, tie: str, status: str) -> DataFrame:
    """One row per status change; the first status of a key is not a change."""
    rows = previous_values(updates, [key], F.date_trunc("day", F.col(time)), [time, tie], [status])
    return status_changes(rows, key, time, tie, status)


def status_changes(rows: DataFrame, key: str, time: str, tie: str, status: str) -> DataFrame:
    """Status changes of rows that stand beside their previous status, from a batch or a stream of placed rows."""
    changed = F.col("has_previous") & ~F.col(f"previous_{status}").eqNullSafe(F.col(status))
    return rows.filter(changed).select(key, time, tie, F.col(f"previous_{status}").alias("old_status"), F.col(status).alias("new_status"))


def deadline_alerts(opportunities: DataFrame, today: Column, sent: DataFrame | None = None) -> DataFrame:
    """Alerts for deadlines three, one or no days ahead, not sent before.

    opportunities: opportunity_id, user_id, notice_id, status, internal_due (date), closes_at.
    """
    rows = _due_dates(opportunities)
    rows = rows.withColumn("days_left", F.datediff("due_date", today)).filter(F.col("days_left").isin(fixed.ALERT_DAYS))
    if sent is None:
        return first_per_key(rows, _ALERT_KEY, [F.col("due_date")])
    return insert_ignore(sent, rows, _ALERT_KEY, [F.col("due_date")])


_ALERT_KEY = ["opportunity_id", "kind", "days_left"]


def _due_dates(opportunities: DataFrame) -> DataFrame:
    """The deadlines of both kinds of the opportunities that are not closed."""
    active = opportunities.filter(~F.col("status").isin(fixed.CLOSED_STATUSES))
    dates = F.array(
        F.struct(F.lit("prazo_interno").alias("kind"), F.col("internal_due").cast("date").alias("due_date")),
        F.struct(F.lit("encerramento_proposta").alias("kind"), F.col("closes_at").cast("date").alias("due_date")),
    )
    return active.select("opportunity_id", "user_id", "notice_id", F.inline(dates))


def deadline_alert_stream(days: DataFrame, day: str, opportunities: DataFrame, memory: str = "10 days") -> DataFrame:
    """Deadline alerts of a stream of run days, each once however often a day is run.

    Every deadline becomes a row per day on which it alerts, so runs meet deadlines by an equal day. What was
    alerted is remembered in the state store for ``memory`` after the run day; it must outlast the days on which
    a run may be repeated. A run day behind the newest one by more than that is dropped, as its alerts are overdue.
    Opportunities are read anew by each start of the stream.
    """
    ahead = F.explode(F.array(*map(F.lit, sorted(fixed.ALERT_DAYS)))).alias("days_left")
    due = _due_dates(opportunities).filter("due_date is not null").select("*", ahead)
    due = due.withColumn("_alert_day", F.date_sub("due_date", F.col("days_left")))
    runs = days.select(F.col(day).cast("date").cast("timestamp").alias("_run")).withWatermark("_run", memory)
    rows = runs.join(due, F.col("_run").cast("date") == F.col("_alert_day"))
    return rows.dropDuplicatesWithinWatermark(_ALERT_KEY).drop("_run", "_alert_day")


def config_change_flags(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """New configurations with a pending mark and time where a prospecting field changed."""
    changed = changed_configs(old, new).select("org_id", F.lit(True).alias("pending"))
    rows = new.join(changed, "org_id", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))
    return rows.withColumn("changed_at", F.when(F.col("pending"), now))


def collection_by_day(notices: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """Rows collected per day and key; for a stream, set a watermark on ``time`` first."""
    counts = notices.groupBy(F.window(time, "1 day").alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows_n"))
    return counts.select(F.col("w.start").cast("date").alias("day"), *keys, "rows_n")


def incremental_collect(stream: DataFrame, time: str, keys: list[str], lateness: str = "2 days") -> DataFrame:
    """New rows of a stream of overlapping collection windows, each key once within ``lateness``."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def _in_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str) -> StreamingQuery:
    """Hands over everything there is, a batch at a time. What a batch writes under its number is replaced when the
    batch is repeated after a failure, and never touched by another batch."""
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )


def collect_into(stream: DataFrame, time: str, keys: list[str], folder: str, lateness: str = "2 days") -> StreamingQuery:
    """Appends the new rows of overlapping collection windows to ``folder``, each key once within ``lateness``.

    Rows more than ``lateness`` behind the newest one of earlier batches come too late to be compared with the
    few rows that are read back: they are listed under ``late`` and placed by ``collected``, so none is lost. A
    batch reads back the rows of that stretch of time only and writes nothing but its own.
    """
    spark = stream.sparkSession
    kept = stream.schema

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        newest = F.max(F.col(time).cast("timestamp")).alias("newest")
        before = spark.read.schema("newest timestamp").parquet(f"{folder}/newest/batch={number - 1}").first()[0] if number else None
        bound = F.lit(before).cast("timestamp") - F.expr(f"interval {lateness}")
        is_late = F.coalesce(F.col(time).cast("timestamp") < bound, F.lit(False))
        rows.filter(is_late).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        fresh = rows.filter(~is_late)
        if number:
            known = spark.read.schema(kept).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
            known = known.filter((F.col("batch") < number) & (F.col(time).cast("timestamp") >= bound))
            fresh = insert_ignore(known, fresh, keys, [F.col(time)])
        else:
            fresh = first_per_key(fresh, keys, [F.col(time)])
        fresh.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        top = rows.agg(newest).select(F.greatest("newest", F.lit(before).cast("timestamp")).alias("newest"))
        top.write.mode("overwrite").parquet(f"{folder}/newest/batch={number}")
        rows.unpersist()

    return _in_batches(stream, handle, folder)


def collected(spark: SparkSession, folder: str, time: str, keys: list[str]) -> DataFrame:
    """All that ``collect_into`` has gathered, late rows at their place: the first row of each key."""
    read = lambda part: spark.read.parquet(f"{folder}/{part}").drop("batch")
    return first_per_key(read("rows").unionByName(read("late")), keys, [F.col(time)])


def count_days_into(stream: DataFrame, time: str, keys: list[str], folder: str) -> StreamingQuery:
    """Appends each batch's counts per day and key. Counts add up, so a batch needs no state, writes only days that
    it has rows of, and a row counts however late it comes."""

    def handle(batch: DataFrame, number: int) -> None:
        collection_by_day(batch, time, keys).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    return _in_batches(stream, handle, folder)


def days_so_far(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The counts of all batches of ``count_days_into``."""
    counts = spark.read.parquet(f"{folder}/counts")
    return counts.groupBy("day", *keys).agg(F.sum("rows_n").alias("rows_n"))


def scrape_log_rows(runs: DataFrame) -> DataFrame:
    """Log rows of portal runs: status, rows found, message and duration per municipality and run."""
    ended = F.unix_millis(F.col("ended_at").cast("timestamp"))
    return runs.groupBy("ibge_code", "run_id").agg(
        F.when(F.max("error").isNotNull(), "error").otherwise("success").alias("status"),
        F.count_if(F.col("error").isNull()).alias("found"),
        F.max("error").alias("message"),
        (F.max(ended) - F.min(ended)).alias("duration_ms"),
        F.max("ended_at").alias("created_at"),
    )


def alert_feed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """New rows of an alert table as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write everything available of a stream to parquet and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_changes(
    stream: DataFrame, key: str, time: str, tie: str, fields: list[str], folder: str
) -> StreamingQuery:
    """Change alerts of a stream of observations, against the last one seen of each key.

    Every micro-batch reads the state of the batch before and writes its own alerts and state
    under its number, so a repeated batch replaces its own output and nothing else. The state
    holds one row per key. A row older than the last one seen of its key would need a
    predecessor that is no longer known: it is kept under ``late``, raises no alert and leaves
    the state as it is; the batch job over all observations places it.
    """
    spark = stream.sparkSession
    columns = [key, time, tie, *fields]
    schema = stream.select(*columns).schema

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.select(*columns)
        if number > 0:
            last = spark.read.schema(schema).parquet(f"{folder}/state/batch={number - 1}")
        else:
            last = rows.limit(0)
        seen = last.select(F.col(key).alias("_key"), F.struct(time, tie).alias("_last"))
        placed = rows.join(seen, rows[key].eqNullSafe(seen["_key"]), "left")
        is_late = F.coalesce(F.struct(time, tie) < F.col("_last"), F.lit(False))
        placed.filter(is_late).select(*columns).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        rows = placed.filter(~is_late).select(*columns)
        marked = rows.withColumn("_new", F.lit(True)).unionByName(last.withColumn("_new", F.lit(False)))
        compared = previous_values(marked, [key], F.date_trunc("day", F.col(time)), [time, tie], fields)
        fresh = _alerts(compared.filter("_new"), [key, time, tie], fields)
        fresh.write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}")
        state = first_per_key(marked.drop("_new"), [key], [F.col(time).desc(), F.col(tie).desc()])
        state.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def alerts_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/alerts").drop("batch")
