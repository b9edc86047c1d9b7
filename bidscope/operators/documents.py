"""Tender-document text: cleaning, quality, findings, deadlines, scores.

A document is one row, and everything about it is computed inside that row with array
functions, so these jobs need no shuffle. Whole texts are read, and all findings are kept unless
a caller asks for the first few.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from bidscope.functions import fixed_values as fixed
from bidscope.functions.literals import pair_array, text_array
from bidscope.functions.scores import round_to
from bidscope.operators.skew import evaluate_once, top_k

_LOWER = "a-záéíóúâêôãõç"


def clean_doc_text(text: Column) -> Column:
    """Extracted text without control characters, page numbers and broken lines."""
    steps = [
        (r"[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f]", ""),
        (r"(?iU)p[áa]g(?:ina)?\.?\s*\d+\s*(?:de|/)\s*\d+", ""),
        (r"(?md)^\s*-?\s*\d{1,3}\s*-?\s*$", ""),
        (r"-\s*\n\s*", ""),
        (rf"([{_LOWER}])\s*\n\s*([{_LOWER}])", "$1 $2"),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
        (r"^\s+|\s+$", ""),
    ]
    clean = text
    for pattern, replacement in steps:
        clean = F.regexp_replace(clean, pattern, replacement)
    return clean


def _given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once; inside a lambda of ``use`` it would be evaluated for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def legal_terms_found(text: Column) -> Column:
    terms = text_array(fixed.LEGAL_TERMS)
    return F.coalesce(_given(F.lower(text), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t)))), F.lit(0))


def page_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\f"), F.lit(""))) + 1


def doc_quality(docs: DataFrame, text: str) -> DataFrame:
    """Adds quality (0-1), quality_band and quality_reasons of the extracted text."""
    source = F.coalesce(F.col(text), F.lit(""))
    # lines with a word, and those of them without a third one
    lines = F.filter(F.split(source, "\n"), lambda x: F.rlike(x, F.lit(r"\S")))
    short = lambda x: ~F.rlike(x, F.lit(r"\S\s+\S+\s+\S"))
    counts = _given(lines, lambda x: F.struct(F.size(x).alias("lines"), F.size(F.filter(x, short)).alias("short")))
    rows = evaluate_once(
        docs,
        _length=F.length(source),
        _letters=F.length(F.regexp_replace(source, r"[^\p{L}]+", "")),
        _legal=legal_terms_found(source),
        _counts=counts,
    )
    rows = rows.withColumns({"_lines": F.col("_counts.lines"), "_short": F.col("_counts.short")}).drop("_counts")
    size, legal = F.col("_length"), F.col("_legal")
    alpha = F.col("_letters") / F.nullif(size, F.lit(0))
    broken = F.col("_short") / F.nullif("_lines", F.lit(0))
    points = (
        F.when(size >= 10000, 25).when(size >= 5000, 20).when(size >= 1000, 10).otherwise(0)
        + F.when(size == 0, 0).when(alpha >= 0.7, 25).when(alpha >= 0.5, 15).otherwise(5)
        + 25 * F.least(legal / 10, F.lit(1.0))
        + F.when(F.col("_lines") == 0, 0).when(broken < 0.3, 25).when(broken < 0.5, 15).otherwise(5)
    )
    score = F.when(size == 0, 0.0).otherwise(round_to(points / 100))
    reasons = F.when(size == 0, F.array(F.lit("texto vazio"))).otherwise(
        F.array_compact(
            F.array(
                F.when(size >= 10000, "texto longo (bom)").when(size >= 5000, "texto suficiente")
                .when(size >= 1000, "texto curto").otherwise("texto muito curto"),
                F.when(alpha >= 0.7, "boa proporção de texto").when(alpha >= 0.5, "proporção aceitável")
                .otherwise("muitos caracteres não-textuais"),
                F.when(legal >= 5, F.concat(legal.cast("string"), F.lit(" termos jurídicos encontrados")))
                .otherwise("poucos termos jurídicos"),
                F.when(F.col("_lines") == 0, F.lit(None)).when(broken < 0.3, "baixa fragmentação")
                .when(broken < 0.5, "fragmentação moderada").otherwise("alta fragmentação"),
            )
        )
    )
    band = F.when(F.col("quality") >= 0.7, "boa").when(F.col("quality") >= 0.4, "regular").otherwise("ruim")
    scored = rows.withColumns({"quality": score, "quality_reasons": reasons}).withColumn("quality_band", band)
    return scored.drop("_length", "_letters", "_legal", "_lines", "_short")


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def finding_confidence(snippet: Column) -> Column:
    size = F.length(snippet)
    return F.when(size >= 50, 0.9).when(size >= 30, 0.8).when(size >= 15, 0.7).otherwise(0.5)


def _split_top(pattern: str) -> list[str]:
    """The alternatives of a pattern that stand outside its groups."""
    parts, depth, in_class, escaped, part = [], 0, False, False, ""
    for char in pattern:
        if not escaped:
            in_class = char == "[" or (in_class and char != "]")
            if not in_class:
                depth += (char == "(") - (char == ")")
            if char == "|" and not depth and not in_class:
                parts.append(part)
                part = ""
                continue
        escaped = char == "\\" and not escaped
        part += char
    return [*parts, part]


def leads(pattern: str, least: int = 3) -> list[str] | None:
    """Lower-case letters one of which every match begins with; None if that can't be told."""
    found = []
    for part in _split_top(pattern):
        group = re.match(r"\(\?:([^()\[\]\\]*(?:\[[^\]]*\][^()\[\]\\]*)*)\)(?![?*{])", part)
        if group:
            inner = leads(group[1], least)
            if inner is None:
                return None
            found += inner
            continue
        run = re.match("[A-Za-z]*", part)[0]
        if part[len(run):len(run) + 1] in ("?", "*", "{"):
            run = run[:-1]
        if len(run) < least:
            return None
        found.append(run.lower())
    return found


def _folded(text: Column) -> Column:
    """Lower case, with the few characters that patterns without case take for ASCII letters."""
    return F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik"))


def _candidates(text: Column, patterns: list[tuple[str, str, str]]) -> Column:
    """All matches in taxonomy order whose snippet is longer than ten characters.

    A pattern is only run on texts that hold what its matches begin with.
    """
    def tagged(folded: Column, code: str, label: str, pattern: str) -> Column:
        matches = F.regexp_extract_all(text, F.lit("(?iU)" + pattern), F.lit(0))
        begins = leads(pattern)
        if begins is not None:
            held = F.contains(folded, F.lit(begins[0]))
            for other in begins[1:]:
                held = held | F.contains(folded, F.lit(other))
            matches = F.when(held, matches).otherwise(F.array().cast("array<string>"))
        return F.transform(
            matches,
            lambda m: F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"), _squeeze(m).alias("snippet")),
        )

    found = _given(_folded(text), lambda folded: F.concat(*[tagged(folded, *entry) for entry in patterns]))
    return F.filter(found, lambda f: F.length(f["snippet"]) > 10)


FINDINGS = {
    "documents": fixed.DOCUMENT_PATTERNS,
    "requirements": fixed.REQUIREMENT_PATTERNS,
    "risks": fixed.RISK_PATTERNS,
    "qualifications": fixed.QUALIFICATION_PATTERNS,
}


def with_findings(
    docs: DataFrame, text: str, kinds: list[str] | None = None, limits: dict[str, int] | None = None
) -> DataFrame:
    """Adds one array column of findings (code, label, snippet, confidence) per kind.

    In taxonomy order; a snippet counts once. ``limits`` keeps the first findings of a kind; without
    it all are kept. Equal snippets are found by sorting, so long lists cost no more than n log n.
    """
    rows = docs
    for kind in kinds or list(FINDINGS):
        rows = evaluate_once(rows, _found=_candidates(F.coalesce(F.col(text), F.lit("")), FINDINGS[kind]))
        placed = F.transform(
            "_found", lambda f, i: F.struct(f["snippet"].alias("snippet"), i.alias("i"), f["code"].alias("code"), f["label"].alias("label"))
        )
        rows = evaluate_once(rows, _found=F.sort_array(placed))
        first = F.filter("_found", lambda f, i: (i == 0) | (F.get("_found", i - 1)["snippet"] != f["snippet"]))
        in_order = F.sort_array(
            F.transform(first, lambda f: F.struct(f["i"].alias("i"), f["code"].alias("code"), f["label"].alias("label"), f["snippet"].alias("snippet")))
        )
        if limits and kind in limits:
            in_order = F.slice(in_order, 1, limits[kind])
        found = F.transform(
            in_order,
            lambda f: F.struct(
                f["code"].alias("code"), f["label"].alias("label"), f["snippet"].alias("snippet"),
                finding_confidence(f["snippet"]).alias("confidence"),
            ),
        )
        rows = evaluate_once(rows, **{kind: found}).drop("_found")
    return rows


def findings_long(docs: DataFrame, key: str, kinds: list[str] | None = None) -> DataFrame:
    """One row per finding: key, kind, position, code, label, snippet, confidence."""
    tagged = [
        F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("found")) for kind in kinds or list(FINDINGS)
    ]
    rows = docs.select(key, F.explode(F.array(*tagged)).alias("k"))
    return rows.select(key, "k.kind", F.posexplode("k.found").alias("position", "f")).select(key, "kind", "position", "f.*")


def deadline_kind(context: Column) -> Column:
    words = pair_array([(kind, word) for kind, vocabulary in fixed.DEADLINE_KINDS for word in vocabulary])
    hit = _given(F.lower(context), lambda low: F.get(F.filter(words, lambda w: F.contains(low, w["b"])), F.lit(0)))
    return F.coalesce(hit["a"], F.lit("outros"))


def find_deadlines(text: Column, limit: int | None = None) -> Column:
    """Deadlines as array<struct<value, unit, kind, context, confidence>>.

    The start of the i-th match is the length of the i + 1 pieces before it and the i matches
    between them, so the words around a match are found without a position function.
    """
    seed = F.expr("cast(struct(0, array()) as struct<at: int, out: array<struct<whole: string, amount: string, unit: string, start: int>>>)")

    def place(state: Column, p: Column) -> Column:
        start = state["at"] + p["gap"]
        row = F.struct(p["whole"].alias("whole"), p["amount"].alias("amount"), p["unit"].alias("unit"), start.alias("start"))
        return F.struct((start + F.length(p["whole"])).alias("at"), F.array_append(state["out"], row).alias("out"))

    def placed(raw: str) -> Column:
        pattern = F.lit("(?iU)" + raw)

        def around(wholes: Column) -> Column:
            # the patterns look at nothing outside a match, so its parts are read from the match alone
            pieces = F.split(text, "(?iU)" + raw, -1)
            parts = F.zip_with(wholes, F.slice(pieces, 1, F.size(wholes)), lambda w, gap: F.struct(
                w.alias("whole"), F.regexp_extract(w, "(?iU)" + raw, 1).alias("amount"),
                F.regexp_extract(w, "(?iU)" + raw, 2).alias("unit"), F.length(gap).alias("gap"),
            ))
            # a text without a match is read once
            return F.when(F.size(wholes) > 0, F.aggregate(parts, seed, place)["out"]).otherwise(seed["out"])

        return _given(F.regexp_extract_all(text, pattern, F.lit(0)), around)

    found = [placed(raw) for raw in fixed.DEADLINE_PATTERNS]

    def describe(m: Column) -> Column:
        unit = F.regexp_replace(F.lower(m["unit"]), "s+$", "")
        first = F.greatest(m["start"] - 50, F.lit(0))
        # a substring ends with the text by itself
        around = _squeeze(F.substring(text, first + 1, m["start"] + F.length(m["whole"]) + 100 - first))
        return F.struct(
            m["amount"].try_cast("bigint").alias("value"),
            F.when(unit.startswith("mese"), "mes").otherwise(unit).alias("unit"),
            deadline_kind(around).alias("kind"),
            _squeeze(m["whole"]).alias("context"),
        )

    candidates = F.filter(F.transform(F.concat(*found), describe), lambda d: d["value"].isNotNull())
    none = F.expr("cast(array() as array<struct<value: bigint, unit: string, kind: string, context: string>>)")

    def keep_first(kept: Column, d: Column) -> Column:
        known = F.exists(kept, lambda k: (k["value"] == d["value"]) & (k["unit"] == d["unit"]))
        full = known if limit is None else (F.size(kept) >= limit) | known
        return F.when(full, kept).otherwise(F.array_append(kept, d))

    return F.transform(
        F.aggregate(candidates, none, keep_first),
        lambda d: F.struct(
            d["value"].alias("value"), d["unit"].alias("unit"), d["kind"].alias("kind"), d["context"].alias("context"),
            F.when(d["kind"] == "outros", 0.4).otherwise(0.85).alias("confidence"),
        ),
    )


def doc_risk(risks: Column, deadlines: Column, documents: Column, requirements: Column) -> Column:
    """Struct(score, level, factors); ``documents`` and ``requirements`` are counts."""
    weights = F.expr("map(" + ", ".join(f"'{c}', {w}" for c, w in fixed.RISK_WEIGHTS.items()) + ")")
    codes = F.array_distinct(F.transform(risks, lambda f: f["code"]))
    labels = F.array_distinct(F.transform(risks, lambda f: f["label"]))
    weight = F.aggregate(codes, F.lit(0), lambda acc, c: acc + F.coalesce(F.element_at(weights, c), F.lit(0)))
    short = F.filter(
        deadlines, lambda d: (d["kind"] == "implantacao") & (d["unit"] == "dia") & (d["value"] < 30)
    )
    tight = F.size(short) > 0
    score = F.least(
        weight + F.when(tight, 10).otherwise(0) + F.when(documents > 10, 10).otherwise(0)
        + F.when(requirements > 8, 10).otherwise(0),
        F.lit(100),
    ).cast("double")
    factors = F.concat(
        labels,
        F.array_compact(
            F.array(
                F.when(tight, F.concat(F.lit("prazo curto de implantação ("), F.get(short, F.lit(0))["value"].cast("string"), F.lit(" dias)"))),
                F.when(documents > 10, F.concat(F.lit("muitos documentos exigidos ("), documents.cast("string"), F.lit(")"))),
                F.when(requirements > 8, F.concat(F.lit("muitos requisitos técnicos ("), requirements.cast("string"), F.lit(")"))),
            )
        ),
    )
    level = F.when(score >= 61, "alto").when(score >= 31, "medio").otherwise("baixo")
    return F.struct(score.alias("score"), level.alias("level"), factors.alias("factors"))


def doc_confidence(quality: Column, file_score: Column, filled_kinds: Column, text: Column) -> Column:
    """Struct(score, band) of how far an analysis can be trusted; a missing file scores 0."""
    size = F.length(text)
    by_size = (
        F.when(size >= 10000, 1.0).when(size >= 5000, 0.8).when(size >= 2000, 0.5)
        .otherwise(F.greatest(F.lit(0.1), size / 2000))
    )
    score = round_to(
        round_to(quality * 30, 1)
        + F.coalesce(round_to(F.least(file_score / 80, F.lit(1.0)) * 20, 1), F.lit(0.0))
        + round_to(filled_kinds / 5 * 20, 1)
        + round_to(by_size * 15, 1)
        + round_to(F.least(legal_terms_found(text) / 10, F.lit(1.0)) * 15, 1),
        1,
    )
    band = F.when(score >= 70, "alta").when(score >= 40, "media").otherwise("baixa")
    return F.struct(score.alias("score"), band.alias("band"))


def rank_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate files with score and rank: the likely main document of a notice first.

    files: keys, url, title, kind. Files without address are dropped; ties go by address.
    """
    usable = files.filter(F.coalesce("url", F.lit("")) != "")
    name = F.trim(F.lower(F.coalesce("title", F.lit(""))))
    kind = F.trim(F.lower(F.coalesce("kind", F.lit(""))))
    has_edital = F.contains(name, F.lit("edital"))
    has_terms = F.contains(name, F.lit("termo de refer"))
    main_kind = F.contains(kind, F.lit("edital")) | F.contains(kind, F.lit("termo"))
    secondary = F.exists(text_array(fixed.SECONDARY_FILE_WORDS), lambda w: F.contains(name, w))
    score = (
        F.when(has_edital, 30.0).otherwise(0.0) + F.when(has_terms, 25.0).otherwise(0.0)
        + F.when(main_kind, 20.0).otherwise(0.0) + 7.5 + F.when(~secondary, 10.0).otherwise(0.0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(has_edital, "nome contém 'edital'"),
            F.when(has_terms, "nome contém 'termo de referência'"),
            F.when(main_kind, F.concat(F.lit("tipo do documento: "), F.col("kind"))),
            F.lit("arquivo disponível"),
            F.when(secondary, "penalizado: nome sugere documento secundário").otherwise("não é anexo/aviso/extrato"),
        )
    )
    scored = usable.withColumns({"score": score, "reasons": reasons})
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("url"))
    return scored.withColumn("rank", F.row_number().over(order))


def best_file(files: DataFrame, keys: list[str]) -> DataFrame:
    ranked = rank_files(files, keys).drop("rank")
    return top_k(ranked, keys, [F.col("score").desc(), F.col("url")], 1)
