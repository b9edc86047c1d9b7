"""Table maintenance: upserts, partition replacement, retention, backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bidscope.functions.keys import notice_hash
from bidscope.operators.skew import first_per_key, lookup


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_per_key(df, keys, order)


def upsert_by_key(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Target with the incoming rows inserted or put in place of the same key.

    ``order`` decides which of several incoming rows of a key wins (the first).
    """
    fresh = first_per_key(incoming, keys, order)
    untouched = target.join(fresh.select(*keys), keys, "left_anti")
    return untouched.unionByName(fresh, allowMissingColumns=True)


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows whose key the target does not hold yet, one per key."""
    return first_per_key(incoming.join(target.select(*keys), keys, "left_anti"), keys, order)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace exactly the partitions present in ``df``; the others stay as they are."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def retention_split(notices: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Adds ``expired``: closed, awarded, and ended more than ``days`` days ago."""
    old = F.col("closes_at") < as_of - F.make_dt_interval(F.lit(days))
    expired = ~F.col("is_open") & (F.col("awarded") > 0) & old
    return notices.withColumn("expired", F.coalesce(expired, F.lit(False)))


def retention_counts(notices: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Dry run: how many notices would go, and why the others stay."""
    flagged = retention_split(notices, as_of, days)
    return flagged.agg(
        F.count_if("expired").alias("removed"),
        F.count_if("is_open").alias("kept_open"),
        F.count_if(~F.col("is_open") & (F.col("awarded") == 0)).alias("kept_not_awarded"),
        F.count(F.lit(1)).alias("total"),
    )


def cascade(children: DataFrame, kept_parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is kept."""
    return children.join(kept_parents.select(key), key, "left_semi")


def backfill_hash(items: DataFrame, source: str = "PNCP") -> DataFrame:
    computed = notice_hash(F.lit(source), F.col("org_tax_id"), F.col("year"), F.col("sequence"))
    filled = F.when(F.col("org_tax_id").isNotNull(), computed)
    return items.withColumn("notice_hash", F.coalesce("notice_hash", filled))


def backfill_geo(
    items: DataFrame, notices: DataFrame, municipalities: DataFrame, spread: list[str] | None = None
) -> DataFrame:
    """Fill ibge_code, state and municipality of items from their notice's municipality.

    First by notice hash; items still without a code take the municipality of the
    organisation's notice with the smallest (published_at, notice_hash).
    Items that have a code, or neither hash nor organisation, look nothing up; ``spread`` names columns by which they are
    dealt over the tasks (default: all).
    """
    places = notices.filter(F.col("municipality_id").isNotNull()).join(
        municipalities.select(
            "municipality_id",
            F.col("ibge_code").alias("_code"),
            F.col("state").alias("_state"),
            F.col("name").alias("_name"),
        ),
        "municipality_id",
    )
    place = F.struct("_code", "_state", "_name")
    by_hash = places.groupBy("notice_hash").agg(F.min(place).alias("_by_hash"))
    by_org = places.groupBy("org_tax_id").agg(
        F.min_by(place, F.struct("published_at", "notice_hash")).alias("_by_org")
    )
    missing = F.col("ibge_code").isNull()
    linked = lookup(items, by_hash, "notice_hash", missing, spread)
    joined = lookup(linked, by_org, "org_tax_id", missing & F.col("_by_hash").isNull(), spread or items.columns)
    found = F.coalesce("_by_hash", "_by_org")
    return joined.select(
        *[c for c in items.columns if c not in ("ibge_code", "state", "municipality")],
        F.when(missing, found["_code"]).otherwise(F.col("ibge_code")).alias("ibge_code"),
        F.when(missing, F.coalesce("state", found["_state"])).otherwise(F.col("state")).alias("state"),
        F.when(missing, F.coalesce("municipality", found["_name"]))
        .otherwise(F.col("municipality"))
        .alias("municipality"),
    )


def mark_collected(notices: DataFrame, items: DataFrame) -> DataFrame:
    """Sets items_collected where at least one item of the notice is stored."""
    present = items.select("notice_hash").distinct().withColumn("_present", F.lit(True))
    flag = F.coalesce("items_collected", F.lit(False)) | F.coalesce("_present", F.lit(False))
    return (
        notices.join(present, "notice_hash", "left").withColumn("items_collected", flag).drop("_present")
    )
