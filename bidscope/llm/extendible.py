"""Sharding by extendible hashing: buckets split on one more hash bit until each fits its byte limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bidscope.session import stage

SHARD_BYTES = 4 << 20  # of text
LEVELS = 6  # bits by which buckets that are too large are looked at in one pass
MAX_DEPTH = 128  # 64 bits of the key's hash, then 64 bits of the row's


def _path(keys: list[str], columns: list[str]) -> F.Column:
    """The row's bits as a string: the hash of its key, then the hash of the whole row.

    Rows of one key stay together until the key alone is too large for a shard.
    """
    bits = lambda h: F.lpad(F.bin(h), 64, "0")
    return F.concat(bits(F.xxhash64(*keys)), bits(F.xxhash64(F.lit(1), *columns)))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """``bucket, depth, n_bytes, n_rows`` of the final buckets over ``_path, _bytes``.

    A pass sums the bytes by the next bits of every bucket that is still too large, and takes for each
    of these cells the shortest prefix that fits; what fits nowhere goes into the next pass. A pass moves
    one row per task and cell. It goes up ``LEVELS`` at a time: so many bits above a cell stand at most
    2 ** LEVELS cells together, and what fits there is added up to one cell for the bits above. Rows that
    agree in all bits cannot be split and form a bucket alone.
    """
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    depth = max(0, (max(1, total) // limit).bit_length() - 1)
    open_rows, done, low = rows, None, 0
    while True:
        high = min(MAX_DEPTH, depth + LEVELS)
        cells = open_rows.groupBy(F.substring("_path", 1, high).alias("_cell")).agg(
            F.sum("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_rows")
        )
        bottom, large = high, None
        while large is None or bottom > low:
            top = max(low, bottom - LEVELS)
            levels = range(top, bottom + 1)
            inside = {d: Window.partitionBy(F.substring("_cell", 1, d)) for d in levels}
            sums = [F.struct(F.lit(d).alias("depth"), F.sum("_bytes").over(inside[d]).alias("n_bytes"), F.sum("_rows").over(inside[d]).alias("n_rows")) for d in levels]
            fits = F.filter("_sums", lambda x: (x["n_bytes"] <= limit) | (x["n_rows"] == 1) | (x["depth"] == MAX_DEPTH))
            cells = cells.withColumn("_sums", F.array(*sums)).withColumn("_leaf", F.get(fits, 0))
            cells = stage(cells.select("_cell", "_bytes", "_rows", "_leaf"), "directory")
            leaf = F.substring(F.col("_cell"), F.lit(1), F.col("_leaf.depth"))
            settled = cells.filter((F.col("_leaf.depth") > top) | (F.col("_leaf.depth") == low))
            found = settled.select(leaf.alias("bucket"), "_leaf.depth", "_leaf.n_bytes", "_leaf.n_rows").distinct()
            done = found if done is None else done.unionByName(found)
            large = cells.filter("_leaf is null").select("_cell") if large is None else large
            cells = cells.groupBy(F.substring("_cell", 1, top).alias("_cell")).agg(F.sum("_bytes").alias("_bytes"), F.sum("_rows").alias("_rows"))
            bottom = top
        if high == MAX_DEPTH or large.isEmpty():
            return done
        open_rows = open_rows.join(large, F.substring(open_rows["_path"], 1, high) == large["_cell"], "left_semi")
        low = depth = high


def shard(df: DataFrame, keys: list[str], keep: list[str], text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """The columns ``keep`` of every row with ``n_bytes``, ``shard`` (the bucket's hash prefix),
    ``shard_depth``, ``shard_bytes`` and ``shard_rows``.

    The directory has 2 ** depth entries over the prefixes; a row belongs to the one bucket whose prefix
    its bits begin with. No shard exceeds ``limit`` bytes of text unless it is one row, or rows equal in
    every bit. A null text has no bytes; null keys hash like a value of their own; repeated rows stay
    together. Texts themselves are read once and never moved; an empty table gives an empty result.
    """
    row = F.struct(*[F.col(c) for c in keep])
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = stage(df.select(row.alias("_row"), _path(keys, df.columns).alias("_path"), n_bytes.alias("_bytes")), "hash-bits")
    buckets = stage(directory(rows, limit), "buckets")
    depths = sorted(x[0] for x in buckets.select("depth").distinct().collect())  # at most MAX_DEPTH + 1 numbers
    # Buckets are prefix-free: of a row's prefixes at the depths that occur, exactly one is a bucket.
    prefixes = F.array(*[F.substring("_path", 1, d) for d in depths or [0]])
    placed = rows.select("_row", "_bytes", F.explode(prefixes).alias("bucket")).join(buckets, "bucket")
    return placed.select(
        "_row.*",
        F.col("_bytes").alias("n_bytes"),
        F.col("bucket").alias("shard"),
        F.col("depth").alias("shard_depth"),
        F.col("n_bytes").alias("shard_bytes"),
        F.col("n_rows").alias("shard_rows"),
    )
