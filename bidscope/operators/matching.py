"""Matching many texts against many keywords without comparing every pair."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bidscope.functions.text import any_term_in, keywords_matched, normalize_text
from bidscope.operators.skew import evaluate_once
from bidscope.session import stage

SHARD_KEYWORDS = 50_000  # keywords of one automaton


def keyword_hits(texts: DataFrame, keywords: DataFrame, keep: list[str], text: str = "norm", is_normal: bool = True) -> DataFrame:
    """(keep..., keyword) for every text containing a keyword as a substring.

    ``text`` names the column, normalised already or not. ``keywords`` has normalised ``keyword`` values; empty and null
    ones, and null texts, match nothing. Equal texts are normalised and read once. The keywords become multi-pattern automata of ``SHARD_KEYWORDS`` each: a shard's keywords travel as one
    row to each part of the texts, ahead of them in the part's order, so that a task builds the automaton and
    streams its texts through. The work is the length of the texts, however many keywords there are, and
    nothing passes through the driver.
    """
    spark = texts.sparkSession
    wanted = stage(keywords.select("keyword").filter("keyword <> ''").distinct(), "keywords")
    shards = max(1, -(-wanted.count() // SHARD_KEYWORDS))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = F.pmod(F.xxhash64("keyword"), F.lit(shards))
    packed = wanted.groupBy(shard.alias("shard")).agg(F.collect_list("keyword").alias("keywords"))
    heads = packed.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "shard", "keywords",
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("norm"),
    )
    rows = texts.select(F.col(text).alias("text")).filter("text IS NOT NULL").distinct().select(
        F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.lit(None).cast("array<string>").alias("keywords"), "text",
        (F.col("text") if is_normal else normalize_text(F.col("text"))).alias("norm"),
    )

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, at = None, None
        for batch in batches:
            own, found = [], []
            for part, number, keywords, value, norm in zip(*(x.to_pylist() for x in batch.columns)):
                if keywords is not None:
                    automaton, at = ahocorasick.Automaton(), (part, number)
                    for k in keywords:
                        automaton.add_word(k, k)
                    automaton.make_automaton()
                elif at == (part, number):  # else the shard has no keyword
                    hits = {k for _, k in automaton.iter(norm)}
                    own += [value] * len(hits)
                    found += hits
            yield pa.record_batch([pa.array(own, pa.string()), pa.array(found, pa.string())], names=["_text", "keyword"])

    laid = heads.unionByName(rows).repartition("part", "shard").sortWithinPartitions("part", "shard", F.col("text").asc_nulls_first())
    hits = laid.mapInArrow(matched, "_text string, keyword string")
    return texts.join(hits, F.col(text) == F.col("_text")).select(*keep, "keyword")


def match_fields(df: DataFrame, subject: str, extra: str, keywords: list[str], exclusions: list[str]) -> DataFrame:
    """Keyword matches of a single configuration: exclusion first, then per field.

    Adds subject_matches, extra_matches, terms_found (ordered, distinct), fields_matched and
    matched; an excluded row has no match.
    """
    norm = evaluate_once(
        df,
        _subject=normalize_text(F.coalesce(subject, F.lit(""))),
        _extra=normalize_text(F.coalesce(extra, F.lit(""))),
    )
    text = F.concat_ws(" ", "_subject", "_extra")
    empty = F.array().cast("array<string>")
    excluded = any_term_in(text, exclusions)
    scored = evaluate_once(norm, excluded=excluded).withColumns({
        "subject_matches": F.when(~excluded, keywords_matched(F.col("_subject"), keywords)).otherwise(empty),
        "extra_matches": F.when(~excluded, keywords_matched(F.col("_extra"), keywords)).otherwise(empty),
    })
    found = F.array_distinct(F.concat("subject_matches", "extra_matches"))
    fields = F.array_compact(
        F.array(
            F.when(F.size("subject_matches") > 0, "objeto"),
            F.when(F.size("extra_matches") > 0, "complementar"),
        )
    )
    return scored.withColumns({
        "terms_found": found,
        "fields_matched": fields,
        "matched": F.size(found) > 0,
    }).drop("_subject", "_extra")
