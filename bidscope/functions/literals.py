"""Literal collections as one SQL expression each.

Building a hundred-entry array or map from single literals costs a call into the JVM per
entry; one parsed expression costs one call and folds to the same constant.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values: Iterable[str]) -> Column:
    entries = ", ".join(sql_text(v) for v in values)
    return F.expr(f"array({entries})") if entries else F.expr("cast(array() as array<string>)")


def text_map(pairs: Iterable[tuple[str, str]]) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_text(a)}, {sql_text(b)}" for a, b in pairs) + ")")


def code_name_map(names: dict[int, str]) -> Column:
    return F.expr("map(" + ", ".join(f"{code}, {sql_text(name)}" for code, name in names.items()) + ")")


def pair_array(pairs: Iterable[tuple[str, str]], first: str = "a", second: str = "b") -> Column:
    entries = ", ".join(
        f"named_struct('{first}', {sql_text(a)}, '{second}', {sql_text(b)})" for a, b in pairs
    )
    return F.expr(f"array({entries})")
