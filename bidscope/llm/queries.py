"""The registered queries of this subpackage: each operator over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bidscope.llm import (
    automata,
    bpe,
    extendible,
    periodic,
    piece_spans,
    robust_rules,
    set_join,
    site_posteriors,
    spelling,
    suffix_sort,
    templates,
    warc,
    wrappers,
)
from bidscope.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_template_contamination")
def template_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op2_zip_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (
        SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x,
               min(page_id) OVER (PARTITION BY sha1(h)) AS first
        FROM p
    )
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr(
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(1 + ((CAST('0x' || substr(x, CAST(1 + (5 * i) // 4 AS INT), 2) AS INT) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) AS INT), 1
           )), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d
    """,
)
def zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


@query(
    "op3_suffix_automata",
    f"""
    WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
    later AS (
        SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
    ),
    gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, unnest(range(20)) AS t(j)),
    words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.digests(table(spark, sf_dir, "documents"))


@query(
    "op4_divide_skip",
    f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
    ),
    s AS (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
    ),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a)
    SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y) AS component_id
    FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
    """,
)
def divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op5_extendible_shards")
def extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.shard(table(spark, sf_dir, "documents"), keys=["doc_id"], keep=["doc_id"])


@query("op6_robust_rules")
def robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_rules.quality_rules(table(spark, sf_dir, "documents"))


@query(
    "op7_suffix_sort",
    """
    WITH d AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
    ),
    windows AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM d, unnest(range(0, n - 399)) AS t(i)),
    shared AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM windows) WHERE c > 1),
    runs AS (
        SELECT doc_id, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM shared)
    ),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY doc_id, run),
    pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM spans),
    kept AS (
        SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
               string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) AS t
        FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
    )
    SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
           sha256(unhex(coalesce(t, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def sorted_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sort.digests(table(spark, sf_dir, "documents"))


@query("op8_site_posteriors")
def site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_posteriors.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_host_wrappers")
def host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


@query("op11_spelling_groups")
def spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(table(spark, sf_dir, "documents"))


@query("op12_piece_spans")
def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_spans.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))
