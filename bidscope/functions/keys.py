"""Notice identities, grouping keys and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bidscope.functions import fixed_values as fixed
from bidscope.functions.text import lexical_key


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _hash32(*parts: Column) -> Column:
    joined = F.concat(*[p for part in parts for p in (F.lit(":"), _text(part))][1:])
    return F.substring(F.sha2(joined, 256), 1, 32)


def notice_hash(source: Column, tax_id: Column, year: Column, sequence: Column) -> Column:
    """First 32 hex digits of SHA-256 over source:tax id:year:sequence."""
    return _hash32(source, tax_id, year, sequence)


def notice_text_hash(source: Column, municipality: Column, subject: Column, published: Column) -> Column:
    """Identity of a notice without a tax id."""
    return _hash32(
        source, municipality, F.substring(_text(subject), 1, 100), F.substring(_text(published), 1, 10)
    )


def natural_key(tax_id: Column, year: Column, sequence: Column) -> Column:
    return F.concat(_text(tax_id), F.lit("_"), _text(year), F.lit("_"), _text(sequence))


def group_keys(code: Column, terms: Column, unit: Column) -> Column:
    """Up to three grouping keys of an item: exact code, four-digit code with terms, terms.

    ``terms`` holds at most six sorted terms, ``unit`` the canonical unit.
    """
    code = _text(code)
    has_code = F.length(code) >= 4
    has_terms = F.size(terms) >= 2
    lexical = lexical_key(terms)
    return F.array_compact(
        F.array(
            F.when(has_code, F.concat(F.lit("ncm:"), code, F.lit(":"), unit)),
            F.when(
                has_code & has_terms,
                F.concat(F.lit("ncm4:"), F.substring(code, 1, 4), F.lit(":"), lexical, F.lit(":"), unit),
            ),
            F.when(has_terms, F.concat(F.lit("desc:"), lexical, F.lit(":"), unit)),
        )
    )


def key_kind(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def humanize_key(key: Column, description: Column) -> Column:
    """Readable label of a grouping key."""
    parts = F.split(key, ":")
    part = lambda i: F.get(parts, F.lit(i))
    dash = F.lit(" — ")
    code = part(1)
    shown = F.when(
        F.length(code) >= 6,
        F.concat(F.substring(code, 1, 4), F.lit("."), F.substring(code, 5, 2)),
    ).otherwise(code)
    return (
        F.when(
            (part(0) == "ncm") & (F.size(parts) >= 3),
            F.concat(F.lit("NCM "), shown, dash, description, dash, F.upper(part(2))),
        )
        .when(
            (part(0) == "ncm4") & (F.size(parts) >= 4),
            F.concat(F.lit("NCM "), code, F.lit(".xx"), dash, part(2), dash, F.upper(part(3))),
        )
        .when((part(0) == "desc") & (F.size(parts) >= 3), F.concat(part(1), dash, F.upper(part(2))))
        .otherwise(key)
    )


def place_label(municipality: Column, state: Column) -> Column:
    return F.concat(_text(municipality), F.lit("/"), _text(state))


def relevance_rank(relevance: Column) -> Column:
    """Sort position of a relevance label; unknown labels come last."""
    ranks = F.create_map(
        *[F.lit(p) for i, name in enumerate(fixed.RELEVANCE_ORDER) for p in (name, i)]
    )
    return F.coalesce(F.element_at(ranks, relevance), F.lit(len(fixed.RELEVANCE_ORDER)))
