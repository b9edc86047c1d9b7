"""Dimension tables: municipalities, microregions, platforms, code lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bidscope.functions import fixed_values as fixed
from bidscope.functions.parsing import fpm_coefficient
from bidscope.operators.skew import first_per_key


def latest_population(series: DataFrame) -> DataFrame:
    """Latest value per municipality of (ibge_code, year, value); '-' and '' mean unknown."""
    latest = series.groupBy("ibge_code").agg(F.max_by("value", "year").alias("value"))
    known = F.when(~F.col("value").isin("", "-"), F.col("value").try_cast("int"))
    return latest.select("ibge_code", known.alias("population"))


def build_municipality_dim(
    municipalities: DataFrame, population: DataFrame, states: list[str] | None = None,
    max_population: int = fixed.POPULATION_UNKNOWN,
) -> DataFrame:
    """Municipalities with population and transfer coefficient, optionally filtered."""
    joined = municipalities.join(latest_population(population), "ibge_code", "left")
    people = F.coalesce("population", F.lit(fixed.POPULATION_UNKNOWN))
    rows = joined.withColumn("population", people).withColumn("fpm", fpm_coefficient(F.col("population")))
    if states is not None:
        rows = rows.filter(F.col("state").isin(states))
    return rows.filter(F.col("population") <= max_population)


def build_microregion_dim(municipalities: DataFrame, names: DataFrame, states: list[str]) -> DataFrame:
    """Distinct microregions of the states with their names (default '' and 0)."""
    present = municipalities.filter(F.col("state").isin(states) & F.col("microregion_id").isNotNull())
    distinct = first_per_key(present.select("microregion_id", "state"), ["microregion_id"], [F.col("state")])
    return (
        distinct.join(names, "microregion_id", "left")
        .fillna({"name": "", "mesoregion_name": "", "mesoregion_id": 0})
    )


def platform_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.PLATFORMS, "platform_id INT, platform STRING, platform_type STRING")


def with_platform_name(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Adds platform and platform_type by platform_id; unknown ids get a placeholder name."""
    named = df.join(F.broadcast(platform_dim(spark)), "platform_id", "left")
    placeholder = F.concat(F.lit("Plataforma #"), F.col("platform_id").cast("string"))
    return named.withColumn("platform", F.coalesce("platform", placeholder))


def domain_code_dim(spark: SparkSession) -> DataFrame:
    rows = [(d, code, name) for d, codes in fixed.DOMAIN_CODES.items() for code, name in codes.items()]
    return spark.createDataFrame(rows, "domain STRING, code INT, name STRING")


def with_domain_name(df: DataFrame, spark: SparkSession, domain: str, code: str, name: str) -> DataFrame:
    codes = domain_code_dim(spark).filter(F.col("domain") == domain)
    return df.join(F.broadcast(codes.select(F.col("code").alias(code), F.col("name").alias(name))), code, "left")


def portal_targets(
    municipalities: DataFrame, registry: DataFrame, microregions: list[int], max_population: int
) -> DataFrame:
    """Municipalities of the microregions that are small enough or have a portal on record,
    reduced to those with an active portal. registry: ibge_code, base_url, active."""
    regional = municipalities.filter(F.col("microregion_id").isin(microregions))
    listed = regional.join(registry.select("ibge_code"), "ibge_code", "left_semi")
    small = regional.filter(F.col("population") <= max_population)
    targets = small.unionByName(listed).dropDuplicates(["ibge_code"])
    return targets.join(registry.filter("active").select("ibge_code", "base_url"), "ibge_code")


def due_for_scrape(targets: DataFrame, scrape_log: DataFrame, as_of, hours: int = 12) -> DataFrame:
    """Targets without a successful run in the last ``hours``."""
    recent = (
        scrape_log.filter(F.col("status") == "success")
        .groupBy("ibge_code")
        .agg(F.max("created_at").alias("last"))
        .filter(F.unix_timestamp(as_of) - F.unix_timestamp("last") < hours * 3600)
    )
    return targets.join(recent, "ibge_code", "left_anti")
