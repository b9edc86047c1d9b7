"""Joins between notices, items, awards and what was derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bidscope.functions import fixed_values as fixed
from bidscope.functions.parsing import parse_notice_url
from bidscope.operators.skew import collect_in_chunks


def items_with_awards_flat(items: DataFrame, awards: DataFrame) -> DataFrame:
    """Every item with each of its awards; items without award keep one row."""
    return items.join(awards, "item_id", "left")


def items_with_awards_nested(items: DataFrame, awards: DataFrame, chunk_rows: int = 1000) -> DataFrame:
    """Items with their awards as an array (empty if none).

    An item with more than ``chunk_rows`` awards has several rows, numbered by ``chunk``.
    """
    fields = [c for c in awards.columns if c != "item_id"]
    nested = collect_in_chunks(
        awards, ["item_id"], F.struct(*fields), "awards", F.struct(*fields), chunk_rows
    )
    none = F.array().cast(nested.schema["awards"].dataType)
    return items.join(nested, "item_id", "left").withColumns({
        "chunk": F.coalesce("chunk", F.lit(0)),
        "awards": F.coalesce("awards", none),
    })


def awards_with_items(awards: DataFrame, items: DataFrame) -> DataFrame:
    return awards.join(items, "item_id")


def notice_items(notices: DataFrame, items: DataFrame) -> DataFrame:
    """Items of notices, linked by notice hash or by (tax id, year, sequence).

    A join on either condition has no key to shuffle by, so every row goes once by each link it has and all meet in one
    join, for which both inputs are read once. ``link`` tells which one held; a pair linked both ways is kept once,
    as linked by hash: it is the one found by its parts.
    """
    theirs = [c for c in items.columns if c not in _LINKING]
    ours = [c for c in notices.columns if c not in theirs]
    kinds = dict(notices.dtypes)
    alike = items.withColumns({c: F.col(c).try_cast(kinds[c]) for c in _LINKING if dict(items.dtypes)[c] != kinds[c]})
    n = _by_link(notices.select(*ours), "n").select(
        *[F.col(c).alias(f"n_{c}") if c in _LINKING else F.col(c) for c in ours], "n_key", "n_hash", "n_parts"
    )
    pairs = _by_link(alike, "i").drop(*_LINKING).join(n, F.col("i_key") == F.col("n_key"))
    same = lambda what: F.coalesce(F.col(f"i_{what}") == F.col(f"n_{what}"), F.lit(False))
    by_hash = F.startswith("i_key", F.lit(_HASH)) | same("hash")
    return pairs.filter(~same("parts")).select(
        *theirs, *[F.col(f"n_{c}").alias(c) if c in _LINKING else F.col(c) for c in ours],
        F.when(by_hash, "hash").otherwise("parts").alias("link"),
    )


_LINKING = ("notice_hash", "org_tax_id", "year", "sequence")
_HASH = "#"


def _by_link(rows: DataFrame, side: str) -> DataFrame:
    """Every row under its hash, along with its parts, and again under its parts, along with its hash.

    Keys are short texts. A hash has its sign ahead and parts begin with a number, so that they never meet.
    """
    tax_id = F.nullif("org_tax_id", F.lit(""))
    pieces = [F.length(tax_id), F.lit(":"), tax_id, F.lit(":"), F.col("year"), F.lit(":"), F.col("sequence")]
    parts = F.concat(*[piece.cast("string") for piece in pieces])  # null without one of them
    hash_, none = F.col("notice_hash"), F.lit(None).cast("string")
    link = lambda key, own, other: F.when(key.isNotNull(), F.struct(key.alias("key"), own.alias("hash"), other.alias("parts")))
    links = F.array_compact(F.array(link(F.concat(F.lit(_HASH), hash_), none, parts), link(parts, hash_, none)))
    # the outer form keeps the engine from making the links again in an inferred filter
    found = rows.select("*", F.inline_outer(links).alias(f"{side}_key", f"{side}_hash", f"{side}_parts"))
    return found.filter(F.col(f"{side}_key").isNotNull())


def not_yet_opportunity(notices: DataFrame, opportunities: DataFrame, user, org) -> DataFrame:
    """Notices neither the user nor the organisation works on."""
    own = opportunities.filter((F.col("user_id") == user) | (F.col("org_id") == org))
    return notices.join(own.select("notice_id"), "notice_id", "left_anti")


def pending_items(notices: DataFrame, items: DataFrame) -> DataFrame:
    """Notices with a usable address and no stored items, with the parts of the address."""
    usable = notices.filter((F.coalesce("org_tax_id", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    usable = usable.filter(F.rlike("url", F.lit(fixed.NOTICE_URL_PATTERN)))
    missing = usable.join(items.select("notice_id"), "notice_id", "left_anti")
    return missing.withColumn("parts", parse_notice_url(F.col("url")))


def pending_awards(items: DataFrame, awards: DataFrame) -> DataFrame:
    """Items said to have a result but without a stored award."""
    return items.filter("has_award").join(awards.select("item_id"), "item_id", "left_anti")


def pending(notices: DataFrame, done: DataFrame, only_open: bool = True) -> DataFrame:
    """Notices not processed yet by a later step (prices, document analysis)."""
    rows = notices.filter("is_open") if only_open else notices
    return rows.join(done.select("notice_id"), "notice_id", "left_anti")


def newest(df: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(limit)
