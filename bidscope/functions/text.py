"""Text normalisation and term extraction as Column expressions.

Everything here is built from native functions, so it stays inside the JVM and can be
pushed around by Catalyst. Normalise a text column once and reuse the result: it is the
dominant CPU cost of the matching jobs.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, functions as F

from bidscope.functions import fixed_values as fixed
from bidscope.functions.literals import pair_array, text_array, text_map


@functools.lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Character tables for compatibility decomposition without combining marks.

    One-to-one foldings feed ``translate``; the few characters that unfold into several
    (fractions, ligatures, ellipsis) are returned separately.
    """
    blocks = [(0xA0, 0x250), (0x1E00, 0x1F00), (0x2000, 0x20A0), (0x2100, 0x2150), (0xFB00, 0xFB07)]
    source, target, longer = [], [], {}
    for low, high in blocks:
        for point in range(low, high):
            char = chr(point)
            folded = "".join(
                c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
            )
            if folded == char or not folded:
                continue
            if len(folded) == 1:
                source.append(char)
                target.append(folded)
            else:
                longer[char] = folded
    return "".join(source), "".join(target), longer


@functools.lru_cache(maxsize=1)
def _has_longer() -> str:
    """Pattern of the characters that unfold into several.

    A class of many single characters tests each in turn; the bounds before it settle the common ones at once.
    """
    points = sorted(map(ord, _folding()[2]))
    starts = [p for p in points if p - 1 not in points]
    ends = [p for p in points if p + 1 not in points]
    inside = "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in zip(starts, ends))
    return f"[[\\u{points[0]:04X}-\\u{points[-1]:04X}]&&[{inside}]]"


def normalize_text(text: Column) -> Column:
    """Drop accents and lower-case.

    A text with as many bytes as characters has nothing to fold.
    """
    source, target, longer = _folding()
    unfold = pair_array(longer.items())
    expanded = F.aggregate(unfold, text, lambda acc, p: F.replace(acc, p["a"], p["b"]))
    has_longer = F.rlike(text, F.lit(_has_longer()))
    folded = F.translate(F.when(has_longer, expanded).otherwise(text), source, target)
    plain = F.octet_length(text) == F.char_length(text)
    return F.lower(F.when(plain, text).otherwise(F.regexp_replace(folded, r"\p{M}+", "")))


def normalized(value: str) -> str:
    """``normalize_text`` of a constant."""
    folded = unicodedata.normalize("NFKD", value)
    return "".join(c for c in folded if not unicodedata.combining(c)).lower()


def normalize_description(text: Column) -> Column:
    """Normalised text with single spaces."""
    return F.trim(F.regexp_replace(normalize_text(text), r"\s+", " "))


def words(norm: Column) -> Column:
    """Whitespace-separated words of an already normalised text."""
    return F.regexp_extract_all(norm, F.lit(r"\S+"), F.lit(0))


def synonym_map(synonyms: dict[str, str] | None = None) -> Column:
    synonyms = fixed.SYNONYMS if synonyms is None else synonyms
    return text_map(synonyms.items())


def apply_synonyms(terms: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Map every term to its canonical form; one step, never chained.

    The map is read entry by entry, so only terms that are in it are looked up.
    """
    known = list(fixed.SYNONYMS if synonyms is None else synonyms)
    if not known:
        return terms
    mapping = synonym_map(synonyms)
    return F.transform(terms, lambda t: F.when(t.isin(known), F.element_at(mapping, t)).otherwise(t))


def extract_terms(
    text: Column,
    min_len: int = 2,
    max_terms: int | None = None,
    synonyms: dict[str, str] | None = None,
    is_normal: bool = False,
) -> Column:
    """Sorted distinct significant terms of a text."""
    normal = text if is_normal else normalize_text(text)
    valid = F.regexp_extract_all(
        F.coalesce(normal, F.lit("")), F.lit(r"(?<!\S)(?!\d+(?!\S))[a-z0-9]{2,}(?!\S)"), F.lit(0)
    )
    if min_len > 2:
        valid = F.filter(valid, lambda t: F.length(t) >= min_len)
    kept = F.filter(valid, lambda t: ~t.isin(fixed.STOP_WORDS))
    terms = F.array_sort(F.array_distinct(apply_synonyms(kept, synonyms)))
    return terms if max_terms is None else F.slice(terms, 1, max_terms)


def lexical_key(terms: Column, size: int = 4) -> Column:
    return F.array_join(F.slice(terms, 1, size), " ")


def item_category(norm: Column) -> Column:
    """First category with a word in the text: service, licence, consumable, else product."""
    tokens = words(F.coalesce(norm, F.lit("")))
    chain = None
    for name, vocabulary in fixed.CATEGORY_WORDS.items():
        hit = F.arrays_overlap(tokens, text_array(vocabulary))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(fixed.DEFAULT_CATEGORY)


def material_or_service(norm: Column) -> Column:
    """'S' or 'M' by which vocabulary has more distinct words in the text; a tie is null."""
    tokens = words(F.coalesce(norm, F.lit("")))
    service = F.size(F.array_intersect(tokens, text_array(fixed.SERVICE_WORDS)))
    material = F.size(F.array_intersect(tokens, text_array(fixed.MATERIAL_WORDS)))
    return F.when(service > material, "S").when(material > service, "M")


def keywords_matched(norm: Column, keywords: list[str]) -> Column:
    """Keywords whose normalised form is a substring of the text, in the given order."""
    if not keywords:
        return text_array([])
    known = pair_array([(k, normalized(k)) for k in keywords])
    hits = F.filter(known, lambda k: F.contains(norm, k["b"]))
    return F.transform(hits, lambda k: k["a"])


def any_term_in(norm: Column, terms: list[str]) -> Column:
    """Whether any of the (to be normalised) terms occurs in the text."""
    hit = F.exists(text_array([normalized(t) for t in terms]), lambda t: F.contains(norm, t))
    return F.coalesce(hit, F.lit(False))


def relevance_by_terms(
    norm: Column, high: list[str] | None = None, medium: list[str] | None = None
) -> Column:
    """ALTA if a high term occurs, else MEDIA if a medium term does, else BAIXA."""
    return (
        F.when(any_term_in(norm, high or fixed.HIGH_TERMS), "ALTA")
        .when(any_term_in(norm, medium or fixed.MEDIUM_TERMS), "MEDIA")
        .otherwise("BAIXA")
    )


def text_match(tokens: Column, terms: list[str], mode: str = "all") -> Column:
    """Full-text predicate on a token array: every term ('all') or at least one ('any')."""
    wanted = text_array(terms)
    if mode == "any":
        return F.arrays_overlap(tokens, wanted)
    return F.size(F.array_except(wanted, tokens)) == 0


def substring_match(norm: Column, term: str) -> Column:
    return F.contains(norm, F.lit(normalized(term)))


def trigrams(text: Column) -> Column:
    """Distinct padded three-letter pieces of every word (two blanks before, one after)."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    pieces = F.transform(
        tokens,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(pieces))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(F.array_union(left, right))
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))
