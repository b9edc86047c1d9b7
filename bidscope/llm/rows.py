"""Keeping the columns an operator does not work on, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def packed(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and all others inside ``_rest``."""
    others = [_column(c) for c in df.columns if c not in keep]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    return df.select(*[_column(c) for c in keep], rest.alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """The columns as they stood before ``packed``."""
    rest = F.col("_rest")
    return df.select(*[_column(c) if c in keep else rest.getField(c).alias(c) for c in columns])
