"""The generic star schema seen through the engine's column roles.

orders are notices, customers municipalities, nations states, lineitem rows with their part
are items, suppliers bucketed by seven are platforms, and a finished line ('F') carries an
award. ``*_SQL`` hold the same views for the SQL side of the checks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from bidscope.session import shared_folder

AS_OF = "2001-08-01"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def municipalities(spark: SparkSession, sf: str) -> DataFrame:
    """Population and microregion are derived from the customer key and balance."""
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"),
        F.col("n_regionkey").alias("region_id"),
    )
    return table(spark, sf, "customer").join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("municipality_id"),
        F.col("c_custkey").cast("string").alias("ibge_code"),
        F.col("c_name").alias("name"),
        "state",
        F.greatest(F.lit(0), F.floor(F.col("c_acctbal") * 20)).cast("int").alias("population"),
        F.col("c_nationkey").alias("microregion_id"),
        "region_id",
    )


MUNICIPALITY_SQL = """municipality AS (
  SELECT c_custkey AS municipality_id, CAST(c_custkey AS VARCHAR) AS ibge_code, c_name AS name,
    n_name AS state, CAST(greatest(0, floor(c_acctbal * 20)) AS INTEGER) AS population,
    c_nationkey AS microregion_id, n_regionkey AS region_id
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def notices(spark: SparkSession, sf: str) -> DataFrame:
    place = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "c_name", "c_mktsegment", "n_name", "c_nationkey")
    status = F.col("o_orderstatus")
    modality = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf, "orders").join(place, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("notice_id"),
        F.col("o_custkey").alias("municipality_id"),
        F.col("c_name").alias("municipality"),
        F.col("n_name").alias("state"),
        F.lpad(F.col("o_custkey").cast("string"), 14, "0").alias("org_tax_id"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderkey").alias("sequence"),
        F.concat_ws(" ", "c_mktsegment", F.expr("substring(o_orderpriority, 3)")).alias("subject"),
        F.concat(F.lit("Prioridade "), F.col("o_orderpriority"), F.lit(" situação "), status).alias("extra_info"),
        modality.alias("modality_id"),
        F.expr("substring(o_orderpriority, 3)").alias("modality"),
        F.when(status == "F", 2).when(status == "O", 1).otherwise(3).alias("status_id"),
        status.alias("status"),
        (status == "O").alias("is_open"),
        F.col("o_totalprice").alias("estimate"),
        F.when(status == "F", F.col("o_totalprice") * 0.9).otherwise(0.0).alias("awarded"),
        F.col("o_orderdate").alias("published_at"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("interval 30 days")).alias("closes_at"),
        (modality <= 2).alias("small_business"),
        F.when(modality <= 2, "ALTA").when(modality == 3, "MEDIA").otherwise("BAIXA").alias("relevance"),
        F.lit("PNCP").alias("source"),
    )


NOTICE_SQL = """notice AS (
  SELECT o_orderkey AS notice_id, o_custkey AS municipality_id, c_name AS municipality,
    n_name AS state, lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS org_tax_id,
    CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS sequence,
    c_mktsegment || ' ' || substr(o_orderpriority, 3) AS subject,
    'Prioridade ' || o_orderpriority || ' situação ' || o_orderstatus AS extra_info,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS modality_id,
    substr(o_orderpriority, 3) AS modality,
    CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 3 END AS status_id,
    o_orderstatus AS status, o_orderstatus = 'O' AS is_open, o_totalprice AS estimate,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice * CAST(0.9 AS DOUBLE) ELSE 0.0 END AS awarded,
    o_orderdate AS published_at, o_orderdate AS created_at,
    o_orderdate + INTERVAL 30 DAY AS closes_at,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 AS small_business,
    CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN 'ALTA'
         WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'MEDIA' ELSE 'BAIXA' END AS relevance,
    'PNCP' AS source
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def items(spark: SparkSession, sf: str, with_state: bool = True) -> DataFrame:
    line = table(spark, sf, "lineitem").join(
        table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    award = F.when(
        F.col("l_linestatus") == "F", F.col("l_extendedprice") * (1 - F.col("l_discount"))
    )
    columns = [
        F.col("l_orderkey").alias("notice_id"),
        F.col("l_linenumber").alias("item_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("p_name").alias("description"),
        F.col("p_type").alias("code"),
        F.when(F.col("l_returnflag") == "N", "un")
        .when(F.col("l_returnflag") == "R", "kg")
        .otherwise("caixa")
        .alias("unit"),
        (F.col("l_suppkey") % 7).cast("int").alias("platform_id"),
        F.concat(F.lit("P"), (F.col("l_suppkey") % 7).cast("string")).alias("platform"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("estimate"),
        award.alias("award"),
        award.alias("best_award"),
        F.col("l_shipdate").alias("created_at"),
    ]
    if not with_state:
        return line.select(*columns)
    place = notices(spark, sf).select(
        F.col("notice_id").alias("l_orderkey"), "state", "municipality", "municipality_id"
    )
    return line.join(place, "l_orderkey").select(*columns, "state", "municipality", "municipality_id")


_ITEM_COLUMNS = """l_orderkey AS notice_id, l_linenumber AS item_no, l_partkey AS part_id,
    l_suppkey AS supplier_id, p_name AS description, p_type AS code,
    CASE l_returnflag WHEN 'N' THEN 'un' WHEN 'R' THEN 'kg' ELSE 'caixa' END AS unit,
    CAST(l_suppkey % 7 AS INTEGER) AS platform_id, 'P' || (l_suppkey % 7) AS platform,
    l_quantity AS quantity, l_extendedprice AS estimate,
    CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) END AS award,
    CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) END AS best_award,
    l_shipdate AS created_at"""

ITEM_SQL = f"""item AS (
  SELECT {_ITEM_COLUMNS}, n_name AS state, c_name AS municipality, c_custkey AS municipality_id
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""

PLAIN_ITEM_SQL = f"""item AS (
  SELECT {_ITEM_COLUMNS} FROM lineitem JOIN part ON p_partkey = l_partkey)"""

PRICED_SQL = """priced AS (
  SELECT *, CASE WHEN best_award > 0 THEN best_award ELSE estimate END AS value,
    CASE WHEN best_award > 0 THEN 'awarded' ELSE 'estimated' END AS price_source
  FROM item WHERE estimate > 0)"""


def r(expr: str, digits: int = 2) -> str:
    """The engine's half-up decimal rounding in SQL."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def rsum(expr: str) -> str:
    """The engine's exact sum of amounts in SQL."""
    return r(f"sum(CAST({expr} AS DECIMAL(20,6)))")


def stats_sql(source: str, keys: str, value: str, trim: bool = True) -> str:
    """CTE body with the grouped price statistics of the engine, by plain windows."""
    keep = "n < 4 OR v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)" if trim else "TRUE"
    k = keys
    return f"""
  SELECT {k}, max(n) AS total_raw, count(*) AS total, {r('min(v)')} AS minimum,
    {r('max(v)')} AS maximum, {r('avg(v)')} AS mean,
    {r('quantile_cont(v, 0.5)')} AS median,
    {r('CASE WHEN max(m) < 4 THEN avg(v) ELSE avg(v) FILTER (rk > cut AND rk <= m - cut) END')} AS trimmed_mean,
    {r('CASE WHEN count(*) >= 2 THEN stddev_samp(v) END')} AS stdev,
    {r('CASE WHEN count(*) >= 2 AND avg(v) <> 0 THEN stddev_samp(v) / avg(v) * 100 END')} AS cv,
    {r('quantile_cont(v, 0.25)')} AS p25, {r('quantile_cont(v, 0.5)')} AS p50,
    {r('quantile_cont(v, 0.75)')} AS p75
  FROM (
    SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY v) AS rk,
      count(*) OVER (PARTITION BY {k}) AS m,
      greatest(1, CAST(floor(count(*) OVER (PARTITION BY {k}) * 0.1) AS BIGINT)) AS cut
    FROM (
      SELECT *, max(CASE WHEN rn = n // 4 + 1 THEN v END) OVER (PARTITION BY {k}) AS q1,
        max(CASE WHEN rn = (3 * n) // 4 + 1 THEN v END) OVER (PARTITION BY {k}) AS q3
      FROM (
        SELECT {k}, {value} AS v, row_number() OVER (PARTITION BY {k} ORDER BY {value}) AS rn,
          count(*) OVER (PARTITION BY {k}) AS n
        FROM {source} WHERE {value} IS NOT NULL))
    WHERE {keep})
  GROUP BY {k}"""


def index_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stored index."""
    return f"{shared_folder(spark).rstrip('/')}/bidscope/{name}-{uuid.uuid4().hex}"
