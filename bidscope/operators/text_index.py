"""Stored inverted index: terms of rows, clustered by term, for word search and trigram similarity.

``postings`` holds (term, key, n) with n the key's number of terms, in one folder per bucket of terms and sorted by
term, so a search reads the folders and row groups of its own terms only. ``terms`` holds how many keys have a term.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bidscope.functions.text import trigrams
from bidscope.operators.skew import evaluate_once

BUCKETS = 64  # folders of terms
FILES = 4  # files that the postings of a bucket are dealt into at least, so that a frequent term is not one task's
_NEAR = 1e-9  # bounds on whole numbers allow for rounding; the similarity itself decides


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, key: Column, terms: Column, path: str, buckets: int = BUCKETS) -> None:
    """Index of the non-empty terms of every row. Rows of an equal key, a null one included, count as one text;
    a row without terms is in no posting."""
    posted = _posted(rows, key, terms).withColumn("bucket", _bucket(F.col("term"), buckets))
    part = F.pmod(F.xxhash64("key"), F.lit(FILES))
    dealt = posted.repartition(F.col("bucket"), part).sortWithinPartitions("bucket", "term")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    dealt.limit(0).write.parquet(f"{path}/schema")  # an index without postings has no other file
    counted = _postings(rows.sparkSession, path).groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("keys"))
    counted.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")


def _posted(rows: DataFrame, key: Column, terms: Column) -> DataFrame:
    """``term, key, n`` with one row per key and term, n being the key's number of terms.

    Terms are made once per row and stay together until all of a key's are known, so that its number needs no
    further look at them. Nulls among the terms are left away.
    """
    listed = evaluate_once(rows.select(key.alias("key"), terms.alias("_terms")), _terms=F.array_distinct("_terms"))
    merged = listed.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("_terms"))).alias("_terms"))
    merged = evaluate_once(merged, _terms=F.filter("_terms", lambda t: t != ""))
    return merged.select(F.explode("_terms").alias("term"), "key", F.size("_terms").cast("long").alias("n"))


def _postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/postings")


def write_trigram_index(texts: DataFrame, column: str, path: str, buckets: int = BUCKETS) -> None:
    """Index of the distinct texts of a column under ``text_key``."""
    distinct = texts.select(column).filter(F.col(column).isNotNull()).distinct()
    write_index(distinct, text_key(F.col(column)), trigrams(F.col(column)), path, buckets)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def postings(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Postings of some terms; folders and row groups without them are not read."""
    wanted = [F.lit(t) for t in sorted(set(terms))]
    return _postings(spark, path).filter(F.col("bucket").isin([_bucket(t, buckets) for t in wanted]) & F.col("term").isin(wanted))


def keys_with_terms(spark: SparkSession, path: str, terms: list[str], mode: str = "all", buckets: int = BUCKETS) -> DataFrame:
    """``key`` of the rows that hold every term ('all') or at least one ('any'); no terms find nothing."""
    found = postings(spark, path, terms, buckets)
    if mode == "any":
        return found.select("key").distinct()
    counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") == len(set(terms))).select("key")


def texts_like(spark: SparkSession, path: str, text: str, threshold: float = 0.3, buckets: int = BUCKETS) -> DataFrame:
    """``key, similarity`` of the indexed texts whose trigrams are similar to one text's, counted from postings."""
    _check(threshold)
    wanted = spark.range(1).select(trigrams(F.lit(text)).alias("t")).first()["t"]  # of the question only
    n = len(wanted)
    found = postings(spark, path, wanted, buckets).filter(_may_link(F.lit(n), F.col("n"), threshold))
    shared = found.groupBy("key", "n").agg(F.count(F.lit(1)).alias("_shared"))
    return _similar(shared.withColumn("_asked", F.lit(n)), threshold).select("key", "similarity")


def _check(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")


def _may_link(asked: Column, n: Column, threshold: float) -> Column:
    return (n >= asked * threshold - _NEAR) & (n * threshold <= asked + _NEAR)


def _similar(shared: DataFrame, threshold: float) -> DataFrame:
    """Rows with ``_shared, _asked, n`` whose share of common trigrams reaches the threshold."""
    value = F.col("_shared") / (F.col("_asked") + F.col("n") - F.col("_shared"))
    return shared.withColumn("similarity", value).filter(F.col("similarity") >= threshold)


def similar_texts(
    spark: SparkSession, path: str, questions: DataFrame, column: str, threshold: float = 0.3, buckets: int = BUCKETS
) -> DataFrame:
    """``question, key, similarity`` of the indexed texts similar to each distinct text of a column.

    A similar text shares at least a threshold's part of the question's trigrams, so it holds one of the
    question's rarest ones already when the rest is left away. Candidates come from these; what they share of
    the rest is counted from the postings for candidates only. Null and empty questions find nothing.
    """
    _check(threshold)
    asked = questions.select(F.col(column).alias("question")).filter("question is not null").distinct()
    asked = asked.withColumn("_terms", trigrams(F.col("question"))).withColumn("_asked", F.size("_terms"))
    rows = asked.select("question", "_asked", F.explode("_terms").alias("term")).withColumn("bucket", _bucket(F.col("term"), buckets))
    counted = spark.read.schema("term string, keys bigint, bucket int").parquet(f"{path}/terms")
    rows = rows.join(counted, ["bucket", "term"], "left").fillna(0, ["keys"])
    rank = F.row_number().over(Window.partitionBy("question").orderBy("keys", "term"))
    tried = F.col("_asked") - F.ceil(F.col("_asked") * threshold - _NEAR) + 1
    rows = rows.withColumns({"_tried": tried, "_rare": rank <= tried}).filter("keys > 0")
    stored = _postings(spark, path)
    met = rows.filter("_rare").join(stored, ["bucket", "term"]).filter(_may_link(F.col("_asked"), F.col("n"), threshold))
    met = met.groupBy("question", "_asked", "_tried", "key", "n").agg(F.count(F.lit(1)).alias("_common"))
    least = F.ceil((F.col("_asked") + F.col("n")) * (threshold / (1 + threshold)) - _NEAR)
    met = met.filter(F.col("_common") + F.col("_asked") - F.col("_tried") >= least)
    rest = rows.filter("not _rare").select("question", "bucket", "term")
    probes = met.select("question", "key").join(rest, "question")
    more = probes.join(stored.select("bucket", "term", "key"), ["bucket", "term", "key"])
    more = more.groupBy("question", "key").agg(F.count(F.lit(1)).alias("_more"))
    found = met.join(more, ["question", "key"], "left").withColumn("_shared", F.col("_common") + F.coalesce("_more", F.lit(0)))
    return _similar(found, threshold).select("question", "key", "similarity")
