"""Other notice sources: gazettes, audit courts, portal records and portal pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bidscope.functions import fixed_values as fixed
from bidscope.functions.literals import pair_array
from bidscope.functions.parsing import detect_modality, parse_br_date, parse_br_money, process_number
from bidscope.functions.text import keywords_matched, normalize_text, relevance_by_terms
from bidscope.operators.skew import evaluate_once, first_per_key
from bidscope.session import stage

SOURCE_COLUMNS = {
    "municipality": "string", "state": "string", "ibge_code": "string", "org_name": "string",
    "org_tax_id": "string", "subject": "string", "small_business": "boolean", "modality": "string",
    "estimate": "double", "awarded": "double", "status": "string", "published_at": "string",
    "opens_at": "string", "closes_at": "string", "url": "string", "keywords": "string",
    "relevance": "string", "source": "string", "year": "string", "sequence": "string",
}
_DEFAULTS = {"boolean": False, "double": 0.0, "string": ""}


def _source_row(df: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    """Notice rows of one source; columns not given take the empty default of their type."""
    columns = [
        values.get(name, F.lit(_DEFAULTS[kind])).cast(kind).alias(name)
        for name, kind in SOURCE_COLUMNS.items()
    ]
    return df.select(*keep, *columns)


def _or_empty(value: str | Column) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column.cast("string"), F.lit(""))


def _midnight(day: Column) -> Column:
    return F.when(day != "", F.concat(day, F.lit("T00:00:00"))).otherwise("")


def gazette_to_notice(
    gazettes: DataFrame, targets: DataFrame, keep: list[str] | None = None, min_chars: int = 1
) -> DataFrame:
    """One notice per distinct gazette excerpt of a target municipality.

    gazettes: territory_id, territory_name, date, url, query, excerpts. targets: ibge_code,
    name, state. Excerpts are distinct by territory, date and whole text; the smallest query
    wins. Excerpts of fewer than ``min_chars`` characters are left out.
    """
    keep = keep or []
    places = targets.select(F.col("ibge_code").alias("territory_id"), "name", "state")
    rows = gazettes.withColumn("date", _or_empty("date")).select(
        *keep, "territory_id", "territory_name", "date", "url", "query", F.explode_outer("excerpts").alias("excerpt")
    )
    rows = rows.filter(F.col("excerpt").isNotNull()).join(places, "territory_id")
    rows = first_per_key(rows, ["territory_id", "date", "excerpt"], [F.col("query"), *keep])
    rows = rows.withColumn("_clean", F.trim(F.replace("excerpt", F.lit("\n"), F.lit(" "))))
    rows = rows.filter(F.length("_clean") >= min_chars)
    return _source_row(
        rows,
        keep,
        municipality=F.col("name"),
        state=F.col("state"),
        ibge_code=F.col("territory_id"),
        org_name=F.coalesce("territory_name", "name"),
        subject=F.col("_clean"),
        modality=F.lit("Diário Oficial"),
        status=F.lit("Publicado no DO"),
        published_at=_midnight(F.col("date")),
        url=_or_empty("url"),
        keywords=F.replace("query", F.lit('"'), F.lit("")),
        relevance=F.lit("MEDIA"),
        source=F.lit("QUERIDO_DIARIO"),
        year=F.substring("date", 1, 4),
    )


def audit_court_to_notice(
    records: DataFrame, keywords: list[str], high: list[str] | None = None,
    medium: list[str] | None = None, state: str = "RJ", source: str = "TCE_RJ",
    keep: list[str] | None = None,
) -> DataFrame:
    """Audit-court records whose subject has a keyword, one per municipality, document and year.

    records: municipality, ibge_code, year, number, subject, unit, modality, estimate,
    published_at (text day), awarded_at.
    """
    keep = keep or []
    rows = evaluate_once(records, _norm=normalize_text(_or_empty("subject")))
    rows = evaluate_once(rows, _found=keywords_matched(F.col("_norm"), keywords))
    rows = rows.withColumn("_town", F.upper("municipality")).filter(F.size("_found") > 0)
    rows = first_per_key(
        rows, ["_town", "number", "year"], [F.col("published_at").asc_nulls_last(), F.col("subject"), *keep]
    )
    return _source_row(
        rows,
        keep,
        municipality=F.col("municipality"),
        state=F.lit(state),
        ibge_code=_or_empty("ibge_code"),
        org_name=_or_empty("unit"),
        subject=_or_empty("subject"),
        modality=_or_empty("modality"),
        estimate=F.coalesce("estimate", F.lit(0.0)),
        status=F.when(_or_empty("awarded_at") != "", "Homologada").otherwise("Publicada"),
        published_at=_midnight(_or_empty("published_at")),
        keywords=F.array_join("_found", ", "),
        relevance=relevance_by_terms(F.col("_norm"), high, medium),
        source=F.lit(source),
        year=_or_empty("year"),
        sequence=_or_empty("number"),
    )


PORTAL_RECORD = """
objeto STRING, descricao STRING, description STRING, data_publicacao STRING,
data_abertura STRING, created_at STRING, data_encerramento STRING, valor_estimado STRING,
valor STRING, valor_total STRING, modalidade STRING, numero_processo STRING, numero STRING,
orgao STRING, cnpj STRING, situacao STRING, status STRING, url STRING, exclusivo_me_epp BOOLEAN
"""


def portal_api_to_notice(replies: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Raw portal rows from interface replies: a bare list, or a list under data, items or licitacoes."""
    record = f"array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in PORTAL_RECORD.split(','))}>>"
    lists = [F.from_json(F.col(body), record)]
    for field in ("data", "items", "licitacoes"):
        lists.append(F.from_json(F.get_json_object(body, f"$.{field}"), record))
    is_list = F.ltrim(F.col(body)).startswith("[")
    listed = F.when(is_list, lists[0]).otherwise(F.coalesce(*lists[1:]))
    rows = replies.select(*keep, F.explode_outer(listed).alias("r"))

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(f"r.{n}"), F.lit("")) for n in names], F.lit(""))

    day = first("data_publicacao", "data_abertura", "created_at")
    published = F.when((day != "") & ~F.contains(day, F.lit("T")), F.concat(F.substring(day, 1, 10), F.lit("T00:00:00")))
    amounts = [F.col(f"r.{n}").try_cast("double") for n in ("valor_estimado", "valor", "valor_total")]
    raw = rows.select(
        *keep,
        first("objeto", "descricao", "description").alias("subject"),
        first("modalidade").alias("modality"),
        F.coalesce(published, day).alias("published_at"),
        first("data_abertura").alias("opens_at"),
        first("data_encerramento").alias("closes_at"),
        F.coalesce(*[F.when(a != 0, a) for a in amounts], F.lit(0.0)).alias("estimate"),
        first("numero_processo", "numero").alias("process_number"),
        F.nullif(first("orgao"), F.lit("")).alias("org_name"),
        first("cnpj").alias("org_tax_id"),
        F.coalesce(F.nullif(first("situacao", "status"), F.lit("")), F.lit("Publicada")).alias("status"),
        first("url").alias("url"),
        F.coalesce("r.exclusivo_me_epp", F.lit(False)).alias("small_business"),
    )
    return raw.filter(F.col("subject") != "")


# ---------------------------------------------------------------- portal pages

_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©",
             "&middot;": "·", "&ordm;": "º", "&amp;": "&"}


def _unescape(text: Column) -> Column:
    plain = F.aggregate(pair_array(_ENTITIES.items()), text, lambda acc, e: F.replace(acc, e["a"], e["b"]))
    return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)


_VOID_TAGS = ["br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed"]
_BLOCK_TAGS = ["div", "article", "section", "main", "body", "html", "ul", "ol", "li", "table", "tr", "td", "header", "footer", "nav"]


def _tokens(html: Column) -> Column:
    """Tags and text pieces of a page in order, without scripts, styles and comments."""
    clean = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    return F.regexp_extract_all(clean, F.lit(r"(?s)<[^>]*>|[^<]+"), F.lit(0))


def _joined_text(tokens: Column, separator: str) -> Column:
    pieces = F.transform(F.filter(tokens, lambda t: ~t.startswith("<")), lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    return _unescape(F.array_join(F.filter(pieces, lambda t: t != ""), separator))


def _first_link(html: Column, page: Column) -> Column:
    """First link of a fragment, resolved against the page address."""
    href = F.regexp_extract(html, r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["']""", 1)
    origin = F.regexp_extract(page, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", "")
    return (
        F.when(href == "", page)
        .when(F.rlike(href, F.lit(r"^[a-zA-Z]+://")), href)
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(folder, href))
    )


def table_listings(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Notices from the tables of listing pages (columns html and url).

    A table counts if its first row mentions a notice word; its cells are assigned by the
    header's words. The last matching column of a role wins, the first for the date.
    """
    tables = pages.select(
        *keep, "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))).alias("table_no", "t")
    )
    rows = tables.withColumn("rows", F.regexp_extract_all("t", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0)))
    rows = rows.filter(F.size("rows") >= 2)

    def cells(row: Column) -> Column:
        return F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))

    def plain(cell: Column) -> Column:
        return _joined_text(_tokens(cell), "")

    def any_of(text: Column, vocabulary: list[str]) -> Column:
        return F.rlike(text, F.lit("|".join(vocabulary)))

    def role(text: Column) -> Column:
        chain = None
        for name, vocabulary in fixed.LISTING_COLUMNS:
            label = F.lit(name)
            if name == "date":
                label = F.when(F.contains(text, F.lit("abertura")), "opening").otherwise(name)
            chain = F.when(any_of(text, vocabulary), label) if chain is None else chain.when(any_of(text, vocabulary), label)
        return chain.otherwise("")

    headed = evaluate_once(rows, header=F.transform(cells(F.element_at("rows", 1)), lambda c: F.lower(plain(c))))
    headed = headed.filter(any_of(F.array_join("header", " "), fixed.LISTING_HEADER_WORDS))
    headed = headed.withColumn("roles", F.transform("header", role))
    body = headed.select(
        *keep, "url", "table_no", "roles",
        F.posexplode_outer(F.expr("slice(rows, 2, size(rows))")).alias("row_no", "row"),
    )
    body = evaluate_once(body, cells=cells(F.col("row")))
    body = evaluate_once(body, texts=F.transform("cells", plain))

    def place(name: str) -> Column:
        found = F.array_position("roles", name)
        if name != "date":
            found = F.when(found > 0, F.size("roles") + 1 - F.array_position(F.reverse("roles"), name)).otherwise(0)
        return (found - 1).cast("int")

    def cell(name: str) -> Column:
        return F.coalesce(F.when(place(name) >= 0, F.get("texts", place(name))), F.lit(""))

    wanted = [name for name, _ in fixed.LISTING_COLUMNS] + ["opening"]
    link_cell = F.when(place("subject") >= 0, F.get("cells", place("subject")))
    body = body.select(*keep, "url", "table_no", "row_no", link_cell.alias("link_html"), *[cell(n).alias(f"_{n}") for n in wanted])
    body = evaluate_once(body, date=parse_br_date(F.col("_date")), opening=parse_br_date(F.col("_opening")))
    rows = body.select(
        *keep,
        "table_no",
        "row_no",
        F.col("_subject").alias("subject"),
        F.when(F.col("_modality") != "", F.col("_modality")).otherwise(detect_modality(F.col("_subject"))).alias("modality"),
        _midnight(F.col("date")).alias("published_at"),
        _midnight(F.col("opening")).alias("opens_at"),
        F.lit("").alias("closes_at"),
        F.when(F.col("_value") != "", parse_br_money(F.col("_value"))).otherwise(0.0).alias("estimate"),
        F.when(F.col("_process") != "", F.col("_process")).otherwise(process_number(F.col("_subject"))).alias("process_number"),
        F.when(F.col("_status") != "", F.col("_status")).otherwise("Publicada").alias("status"),
        _first_link(F.col("link_html"), F.col("url")).alias("url"),
    )
    return rows.filter(F.col("subject") != "")


def _from_text(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Notice fields out of free text blocks (columns text, link)."""
    text = F.col("text")
    money = F.regexp_extract(text, fixed.BR_MONEY_PATTERN, 0)
    rows = evaluate_once(rows, date=parse_br_date(text))
    return rows.select(
        *keep,
        text.alias("subject"),
        detect_modality(text).alias("modality"),
        _midnight(F.col("date")).alias("published_at"),
        F.lit("").alias("opens_at"),
        F.lit("").alias("closes_at"),
        F.when(money != "", parse_br_money(money)).otherwise(0.0).alias("estimate"),
        process_number(text).alias("process_number"),
        F.lit("Publicada").alias("status"),
        F.col("link").alias("url"),
    )


def card_listings(pages: DataFrame, keep: list[str], class_pattern: str = fixed.CARD_CLASS_PATTERN) -> DataFrame:
    """Notices from card blocks: div, article or li elements whose class looks like a listing.

    An element reaches to its own end tag, or to the end tag of a block around it where its
    own is missing; unclosed tags inside it end with it.
    """
    start = r"(?is)^<(div|article|li)\b[^>]*\bclass\s*=\s*[\"'][^\"']*(?:" + class_pattern + ")"
    rows = pages.select(*keep, "url", _tokens(F.col("html")).alias("tokens"))
    cards = (
        rows.select("*", F.posexplode("tokens").alias("block_no", "token"))
        .filter(F.rlike("token", F.lit(start)))
        .withColumn("name", F.lower(F.regexp_extract("token", start, 1)))
    )

    def walk(state: Column, token: Column) -> Column:
        stack = state["stack"]
        name = F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
        opens = token.startswith("<") & ~token.startswith("</") & (name != "") & ~name.isin(_VOID_TAGS) & ~token.endswith("/>")
        last = F.size(stack) + 1 - F.array_position(F.reverse(stack), name)
        inside = F.array_contains(stack, name)
        closed = F.when(inside, F.slice(stack, F.lit(1), (last - 1).cast("int"))).when(
            name.isin(_BLOCK_TAGS), F.array().cast("array<string>")
        ).otherwise(stack)
        after = F.when(opens, F.array_append(stack, name)).when(token.startswith("</"), closed).otherwise(stack)
        alive = F.size(stack) > 0
        return F.struct(
            F.when(alive, after).otherwise(stack).alias("stack"),
            F.when(alive, state["size"] + 1).otherwise(state["size"]).alias("size"),
        )

    rest = F.expr("slice(tokens, block_no + 2, size(tokens))")
    seed = F.struct(F.array(F.col("name")).alias("stack"), F.lit(0).alias("size"))
    cards = evaluate_once(cards, size=F.aggregate(rest, seed, walk)["size"])
    cards = cards.withColumn("inner", F.expr("slice(tokens, block_no + 2, size)"))
    cards = evaluate_once(cards, text=_joined_text(F.col("inner"), " ")).filter(F.length("text") >= 20)
    cards = cards.withColumn("link", _first_link(F.array_join("inner", ""), F.col("url")))
    return _from_text(cards, [*keep, "block_no"])


def heading_listings(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Notices from headings and links that name a procurement, for pages without cards."""
    pattern = r"(?is)<(h2|h3|h4|a)\b[^>]*>.*?</\1>"
    found = pages.select(
        *keep, "url", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("block_no", "block")
    )
    found = evaluate_once(found, text=_joined_text(_tokens(F.col("block")), ""))
    named = F.rlike("text", F.lit("(?iU)" + fixed.NOTICE_LINK_PATTERN)) & (F.length("text") > 20)
    found = found.filter(named).withColumn("link", _first_link(F.col("block"), F.col("url")))
    return _from_text(found, [*keep, "block_no"])


def portal_pages_to_notice(
    pages: DataFrame, key: str, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """Listing rows of each page: tables, else cards, else headings; optionally by published day.

    The table rows also decide which pages go on to the cards, so they are staged. Pages of few files are dealt
    over all cores first, as the work is in their texts.
    """
    if len(pages.inputFiles()) < pages.sparkSession.sparkContext.defaultParallelism:
        pages = pages.repartition(key)
    from_tables = stage(table_listings(pages, [key]).drop("table_no", "row_no"), "table-listings")
    has_cards = F.rlike(
        "html",
        F.lit(r"(?is)<(?:div|article|li)\b[^>]*\bclass\s*=\s*[\"'][^\"']*(?:" + fixed.CARD_CLASS_PATTERN + ")"),
    )
    others = pages.join(from_tables.select(key).distinct(), key, "left_anti")
    from_cards = card_listings(others.filter(has_cards), [key]).drop("block_no")
    from_headings = heading_listings(others.filter(~has_cards), [key]).drop("block_no")
    rows = from_tables.unionByName(from_cards).unionByName(from_headings)
    if first_day and last_day:
        rows = rows.filter(F.substring("published_at", 1, 10).between(first_day, last_day))
    return rows


def normalize_portal_row(rows: DataFrame, municipalities: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Portal rows (with ibge_code) in the common notice layout."""
    keep = keep or []
    places = municipalities.select("ibge_code", F.col("name").alias("_name"), F.col("state").alias("_state"))
    joined = rows.join(places, "ibge_code")
    optional = lambda name, default: F.coalesce(F.col(name), default) if name in rows.columns else default
    published = _or_empty("published_at")
    return _source_row(
        joined,
        keep,
        municipality=F.col("_name"),
        state=F.col("_state"),
        ibge_code=F.col("ibge_code"),
        org_name=optional("org_name", F.col("_name")),
        org_tax_id=optional("org_tax_id", F.lit("")),
        subject=_or_empty("subject"),
        small_business=optional("small_business", F.lit(False)),
        modality=_or_empty("modality"),
        estimate=F.coalesce("estimate", F.lit(0.0)),
        status=F.coalesce("status", F.lit("Publicada")),
        published_at=published,
        opens_at=_or_empty("opens_at"),
        closes_at=_or_empty("closes_at"),
        url=_or_empty("url"),
        relevance=F.lit("BAIXA"),
        source=F.lit("PORTAL_MUNICIPAL"),
        year=F.when(F.length(published) >= 4, F.substring(published, 1, 4)).otherwise(""),
        sequence=_or_empty("process_number"),
    )


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All enabled sources in one table; columns a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
