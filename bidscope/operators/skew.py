"""Building blocks that keep one hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, position: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key.

    ``row_number() <= k`` lets Spark trim each map task to k rows per key before the
    shuffle, so a hot key sends k rows per task, not all of its rows.
    """
    name = position or "_position"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept if position else kept.drop(name)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def previous_values(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[str],
    columns: list[str],
    prefix: str = "previous_",
) -> DataFrame:
    """Value of the preceding row of the same key, for every row.

    ``bucket`` must grow with ``order`` (a day or hour of the ordering time). Rows are
    compared inside (key, bucket); the first row of a bucket takes the last row of the
    key's previous non-empty bucket, found on one pre-aggregated row per (key, bucket).
    ``has_previous`` tells a missing predecessor from a null value.
    """
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    value = F.struct(*columns)
    rows = rows.withColumn("_previous", F.lag(value).over(inside))
    last = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.max(F.struct(*order, value.alias("_last"))).alias("_max"))
        .withColumn("_carried", F.lag("_max._last").over(Window.partitionBy(*keys).orderBy("_bucket")))
        .select(*keys, "_bucket", "_carried")
    )
    # Null keys and null times are values like any others.
    last = last.select(F.struct(*keys, "_bucket").alias("_at"), "_carried")
    joined = rows.join(last, F.struct(*[rows[c] for c in [*keys, "_bucket"]]).eqNullSafe(last["_at"]), "left")
    previous = F.coalesce("_previous", "_carried")
    return joined.select(
        *df.columns,
        previous.isNotNull().alias("has_previous"),
        *[previous[c].alias(prefix + c) for c in columns],
    )


def lookup(df: DataFrame, found: DataFrame, key: str, needed: Column, spread: list[str] | None = None, salts: int = 1 << 16) -> DataFrame:
    """Left join on ``key`` that deals the rows that look nothing up over all tasks.

    Rows with a null key, or for which ``needed`` does not hold, match nothing. A plain left join sends all null keys to
    one task; here such rows go by a hash of the ``spread`` columns instead (default: all, which keeps the engine from
    leaving unused ones behind). ``found`` has one row per key.
    """
    asks = F.col(key).isNotNull() & F.coalesce(needed, F.lit(False))
    salt = F.pmod(F.xxhash64(*(spread or df.columns)), F.lit(salts))
    # the first sign tells keys from salts, so none meets the other
    own = F.when(asks, F.concat(F.lit("="), F.col(key).cast("string"))).otherwise(F.concat(F.lit("#"), salt.cast("string")))
    keyed = found.filter(F.col(key).isNotNull()).withColumn("_key", F.concat(F.lit("="), F.col(key).cast("string")))
    return df.withColumn("_key", own).join(keyed.drop(key), "_key", "left").drop("_key")


def collect_in_chunks(
    df: DataFrame, keys: list[str], value: Column, name: str, spread: Column, chunk_rows: int = 1000
) -> DataFrame:
    """Nest the rows of every key into arrays of about ``chunk_rows`` elements.

    A key with more rows gives several result rows (``chunk`` 0, 1, ...), so no array or
    task has to hold a hot key whole; ordinary keys give exactly one row.
    """
    sizes = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > chunk_rows)
        .withColumn("_chunks", F.ceil(F.col("_n") / chunk_rows))
        .drop("_n")
    )
    chunk = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_chunks")), F.lit(0)).cast("int")
    return (
        df.join(sizes, keys, "left")
        .withColumn("chunk", chunk)
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list(value)).alias(name))
    )


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns so that later filters on them use the computed values.

    A plain projection would let Spark push a filter below it and evaluate the whole
    expression again for the test; filters do not move below a generator.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(row)))
