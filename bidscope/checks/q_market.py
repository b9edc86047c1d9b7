"""Statistics and market comparison over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidscope.checks.registry import query
from bidscope.checks.star import ITEM_SQL, PLAIN_ITEM_SQL, PRICED_SQL, items, r, stats_sql, table
from bidscope.functions.keys import humanize_key
from bidscope.functions.scores import predominant_source, price_of, real_discount, round_to
from bidscope.operators.groups import group_unit, rank_in_group, redundant_groups
from bidscope.operators.order_stats import iqr_filter, price_summary, scale_window
from bidscope.plans import market
from bidscope.session import stage

STATS = "total, minimum, maximum, mean, median, trimmed_mean, stdev, cv, p25, p50, p75"


@query(
    "D1_price_summary",
    f"WITH s AS ({stats_sql('lineitem', 'l_partkey', 'l_extendedprice', trim=False)}) "
    f"SELECT l_partkey, {STATS} FROM s",
)
def price_summary_by_part(spark, sf):
    stats = price_summary(
        table(spark, sf, "lineitem"), ["l_partkey"], "l_extendedprice", trim_outliers=False
    )
    return stats.drop("total_raw")


@query(
    "D1_price_summary_after_iqr",
    f"WITH s AS ({stats_sql('lineitem', 'l_partkey', 'l_extendedprice')}) "
    f"SELECT l_partkey, total_raw, {STATS} FROM s",
)
def price_summary_cleaned(spark, sf):
    return price_summary(table(spark, sf, "lineitem"), ["l_partkey"], "l_extendedprice")


@query(
    "D2_iqr_filter",
    """
SELECT l_partkey, l_extendedprice FROM (
  SELECT *, max(CASE WHEN rn = n // 4 + 1 THEN l_extendedprice END) OVER (PARTITION BY l_partkey) AS q1,
    max(CASE WHEN rn = (3 * n) // 4 + 1 THEN l_extendedprice END) OVER (PARTITION BY l_partkey) AS q3
  FROM (SELECT l_partkey, l_extendedprice,
      row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) AS rn,
      count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem))
WHERE n < 4 OR l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def iqr_rows(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice")
    return iqr_filter(rows, ["l_partkey"], "l_extendedprice")


@query(
    "D3_trimmed_mean",
    f"""WITH o AS (SELECT l_suppkey, l_extendedprice AS v,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rk,
    count(*) OVER (PARTITION BY l_suppkey) AS m FROM lineitem)
SELECT l_suppkey, {r('CASE WHEN max(m) < 4 THEN avg(v) ELSE avg(v) FILTER (rk > greatest(1, m // 10) AND rk <= m - greatest(1, m // 10)) END')}
  AS trimmed_mean FROM o GROUP BY l_suppkey""",
)
def trimmed_mean(spark, sf):
    stats = price_summary(
        table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", trim_outliers=False
    )
    return stats.select("l_suppkey", "trimmed_mean")


@query(
    "D4_coef_variation",
    f"SELECT l_suppkey, {r('stddev_samp(l_extendedprice) / avg(l_extendedprice) * 100')} AS cv "
    "FROM lineitem GROUP BY l_suppkey",
)
def coefficient_of_variation(spark, sf):
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        round_to(F.stddev_samp(price) / F.avg(price) * 100).alias("cv")
    )


@query(
    "D5_percentiles",
    f"""SELECT l_returnflag, l_linestatus, {r('quantile_cont(l_extendedprice, 0.25)')} AS p25,
  {r('quantile_cont(l_extendedprice, 0.5)')} AS p50, {r('quantile_cont(l_extendedprice, 0.75)')} AS p75
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def percentiles(spark, sf):
    keys = ["l_returnflag", "l_linestatus"]
    # six groups over the whole table: each is ranked in value bands
    stats = price_summary(
        table(spark, sf, "lineitem"), keys, "l_extendedprice", trim_outliers=False, hot_rows=5_000
    )
    return stats.select(*keys, "p25", "p50", "p75")


_COUNTS = "count(*) FILTER (l_linestatus = 'F')"


@query(
    "D6_predominant_source",
    f"""SELECT l_partkey, {_COUNTS} AS awarded, count(*) - {_COUNTS} AS estimated,
  CASE WHEN {_COUNTS} > count(*) - {_COUNTS} THEN 'awarded'
       WHEN {_COUNTS} < count(*) - {_COUNTS} THEN 'estimated' ELSE 'mixed' END AS price_source
FROM lineitem GROUP BY l_partkey""",
)
def predominant(spark, sf):
    awarded = F.count_if(F.col("l_linestatus") == "F")
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_partkey")
        .agg(awarded.alias("awarded"), (F.count(F.lit(1)) - awarded).alias("estimated"))
        .withColumn("price_source", predominant_source(F.col("awarded"), F.col("estimated")))
    )


_DISCOUNT = "(l_extendedprice - l_extendedprice * (1 - l_discount)) / l_extendedprice * 100"


@query(
    "D7_mean_discount",
    f"""SELECT l_suppkey, {r('avg(d)')} AS mean_discount FROM (
  SELECT l_suppkey, CASE WHEN l_linestatus = 'F' AND {_DISCOUNT} BETWEEN 0 AND 80 THEN {r(_DISCOUNT)} END AS d
  FROM lineitem) GROUP BY l_suppkey""",
)
def mean_discount(spark, sf):
    award = F.when(
        F.col("l_linestatus") == "F", F.col("l_extendedprice") * (1 - F.col("l_discount"))
    )
    return (
        table(spark, sf, "lineitem")
        .select("l_suppkey", real_discount(F.col("l_extendedprice"), award).alias("d"))
        .groupBy("l_suppkey")
        .agg(round_to(F.avg("d")).alias("mean_discount"))
    )


@query(
    "D8_platform_means",
    f"""WITH {PLAIN_ITEM_SQL}, {PRICED_SQL}
SELECT part_id, platform, {r('avg(value)')} AS mean_unit, count(*) AS items
FROM priced GROUP BY part_id, platform""",
)
def platform_means(spark, sf):
    from bidscope.plans.pricing import platform_means as means

    rows = items(spark, sf, with_state=False).withColumn(
        "value", price_of(F.col("best_award"), F.col("estimate"))["value"]
    )
    return means(rows, ["part_id"])


@query(
    "P13_scale_window",
    """WITH o AS (SELECT l_partkey, l_extendedprice AS v,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) AS rn,
    count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem),
ref AS (SELECT l_partkey, max(n) AS n, max(CASE WHEN rn = n // 2 + 1 THEN v END) AS med FROM o GROUP BY l_partkey)
SELECT o.l_partkey, count(*) AS kept, max(ref.n) - count(*) AS dropped FROM o JOIN ref USING (l_partkey)
WHERE ref.n < 2 OR v BETWEEN med / 20 AND med * 20 GROUP BY o.l_partkey""",
)
def scale_window_rows(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice")
    kept = scale_window(rows, ["l_partkey"], "l_extendedprice")
    totals = rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return (
        kept.groupBy("l_partkey")
        .agg(F.count(F.lit(1)).alias("kept"))
        .join(totals, "l_partkey")
        .select("l_partkey", "kept", (F.col("n") - F.col("kept")).alias("dropped"))
    )


_SETS = """base AS (
  SELECT l_partkey, 'P' || (l_suppkey % 7) AS platform, avg(l_extendedprice) AS m, count(*) AS c
  FROM lineitem GROUP BY ALL)"""


@query(
    "P15_group_scale_ok",
    f"""WITH {_SETS} SELECT l_partkey, count(*) AS platforms, {r('max(m) / min(m)')} AS ratio
FROM base GROUP BY l_partkey HAVING count(*) >= 2 AND min(m) > 0 AND max(m) / min(m) <= 50""",
)
def scale_ok(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn(
        "platform", F.concat(F.lit("P"), (F.col("l_suppkey") % 7).cast("string"))
    )
    means = rows.groupBy("l_partkey", "platform").agg(F.avg("l_extendedprice").alias("m"))
    groups = means.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_platforms"), F.min("m").alias("min_mean"), F.max("m").alias("max_mean")
    )
    return market.group_scale_ok(groups).select(
        "l_partkey",
        F.col("n_platforms").alias("platforms"),
        round_to(F.col("max_mean") / F.col("min_mean")).alias("ratio"),
    )


_LEX = "list_aggregate(list_sort(list_distinct(string_split(description, ' '))), 'string_agg', ' ')"

_KEYED = f"""{PRICED_SQL},
observed AS (SELECT *, CASE unit WHEN 'un' THEN 'pc' WHEN 'caixa' THEN 'caixa' ELSE 'kg' END AS cu,
    {_LEX} AS lex,
    CASE WHEN best_award > 0 AND (estimate - best_award) / estimate * 100 BETWEEN 0 AND 80
         THEN {r('(estimate - best_award) / estimate * 100')} END AS discount
  FROM priced),
keyed AS (
  SELECT level, key, platform, value, price_source, discount, description, code FROM (
    SELECT *, unnest(['ncm:' || code || ':' || cu, 'ncm4:' || code[1:4] || ':' || lex || ':' || cu,
                      'desc:' || lex || ':' || cu]) AS key FROM observed) x,
    (VALUES ('*', 0), ('s', 1)) l(tag, is_state),
    LATERAL (SELECT CASE WHEN is_state = 1 THEN x.state ELSE '*' END AS level) y),
base AS (
  SELECT level, key, platform, count(*) AS n, count(*) FILTER (price_source = 'awarded') AS awarded,
    count(*) FILTER (price_source = 'estimated') AS estimated, avg(value) AS raw_mean,
    CASE WHEN count(*) >= 2 THEN stddev_samp(value) / avg(value) * 100 END AS raw_cv,
    {r('avg(discount)')} AS mean_discount, min(description) AS d
  FROM keyed GROUP BY level, key, platform),
allgroups AS (
  SELECT level, key, string_split(key, ':')[1] AS kind, count(*) AS n_platforms,
    list_sort(list(platform)) AS pset,
    CAST(sum(n) AS BIGINT) AS total_observations, CAST(sum(awarded) AS BIGINT) AS awarded,
    CAST(sum(estimated) AS BIGINT) AS estimated, min(n) AS min_sample, avg(raw_cv) AS mean_cv,
    min(raw_mean) AS min_mean, max(raw_mean) AS max_mean, min(d) AS description
  FROM base GROUP BY level, key)"""

_DEDUP = """,
psets AS (SELECT DISTINCT level, kind, pset FROM allgroups),
covered AS (
  SELECT DISTINCT a.level, a.kind, a.pset FROM psets a JOIN psets b ON a.level = b.level
    AND len(b.pset) >= 2 AND len(list_intersect(a.pset, b.pset)) >= len(a.pset) * 0.5
    AND ((a.kind = 'desc' AND b.kind IN ('ncm', 'ncm4')) OR (a.kind = 'ncm4' AND b.kind = 'ncm'))),
kept AS (SELECT * FROM allgroups g WHERE NOT EXISTS (
    SELECT 1 FROM covered c WHERE c.level = g.level AND c.kind = g.kind AND c.pset = g.pset))"""

_SCORED = f""",
scored AS (
  SELECT *, {r('''(CASE WHEN kind = 'ncm' THEN 20.0 ELSE 0 END) + 20.0
    + (CASE WHEN min_sample >= 5 THEN 15.0 WHEN min_sample >= 3 THEN 10.5 ELSE 4.5 END)
    + (CASE WHEN mean_cv < 15 THEN 15.0 WHEN mean_cv < 30 THEN 9.0 WHEN mean_cv < 50 THEN 3.0 ELSE 0 END)
    + (CASE WHEN awarded / total_observations >= 0.8 THEN 15.0 WHEN awarded / total_observations >= 0.5 THEN 10.5
            WHEN awarded > 0 THEN 4.5 ELSE 0 END)
    + (CASE WHEN max_mean / min_mean <= 5 THEN 15.0 WHEN max_mean / min_mean <= 10 THEN 9.0 ELSE 3.0 END)''')} AS score
  FROM kept WHERE n_platforms >= 2 AND min_mean > 0 AND max_mean / min_mean <= 50),
banded AS (SELECT *, CASE WHEN score >= 70 THEN 'alta' WHEN score >= 40 THEN 'media' ELSE 'baixa' END AS band
  FROM scored),
members AS (SELECT k.* FROM keyed k JOIN banded USING (level, key)),
stats AS ({stats_sql('members', 'level, key, platform', 'value')}),
prices AS (
  SELECT s.*, b.awarded, b.estimated, b.mean_discount, g.score, g.band,
    CASE WHEN b.awarded > b.estimated THEN 'awarded' WHEN b.awarded < b.estimated THEN 'estimated'
         ELSE 'mixed' END AS price_source,
    row_number() OVER (PARTITION BY level, key ORDER BY mean, platform) AS rank,
    min(mean) OVER (PARTITION BY level, key) AS lowest, max(mean) OVER (PARTITION BY level, key) AS highest
  FROM stats s JOIN base b USING (level, key, platform) JOIN banded g USING (level, key))"""

_GROUPS_SELECT = """
SELECT g.level, g.key, g.n_platforms, total_observations, g.awarded, g.estimated, g.score, g.band,
  p.platform AS cheapest_platform, g.description,
  CASE WHEN g.awarded > g.estimated THEN 'awarded' WHEN g.awarded < g.estimated THEN 'estimated'
       ELSE 'mixed' END AS price_source
FROM banded g JOIN prices p ON p.level = g.level AND p.key = g.key AND p.rank = 1"""

_GROUP_COLUMNS = [
    "level", "key", "n_platforms", "total_observations", "awarded", "estimated", "score", "band",
    "cheapest_platform", "description", "price_source",
]

_BOARD_SELECT = f"""
SELECT level, platform, count(*) AS items, {r('avg(mean)')} AS mean_value,
  {r('avg(mean_discount)')} AS mean_discount, {r('avg(cv)')} AS mean_cv, count(*) AS groups,
  count(*) FILTER (band = 'alta') AS high_groups, count(*) FILTER (rank = 1) AS wins,
  {r('sum(CASE WHEN rank = 1 THEN score / 100 ELSE 0 END)')} AS weighted_wins,
  count(*) FILTER (rank = 1 AND band = 'alta') AS high_wins,
  {r('count(*) FILTER (rank = 1) / count(*)')} AS win_share,
  {r('sum(awarded) / (sum(awarded) + sum(estimated))')} AS awarded_share,
  {r('avg(score)')} AS mean_score, {r('avg(rank)')} AS mean_rank,
  {r('avg(least((mean - lowest) / lowest * 100, 500.0))')} AS mean_delta,
  {r('quantile_cont(mean, 0.5)')} AS median_value
FROM prices GROUP BY level, platform"""


def _groups_none(sql_tail: str, items_sql: str = ITEM_SQL) -> str:
    return f"WITH {items_sql}, {_KEYED}, kept AS (SELECT * FROM allgroups){_SCORED}{sql_tail}"


def _groups_dedup(sql_tail: str, items_sql: str = ITEM_SQL) -> str:
    return f"WITH {items_sql}, {_KEYED}{_DEDUP}{_SCORED}{sql_tail}"


@query("D15_market_groups", _groups_dedup(_GROUPS_SELECT))
def market_groups(spark, sf):
    return market.compare_market(items(spark, sf)).groups.select(*_GROUP_COLUMNS)


@query("D15_market_groups_all_keys", _groups_none(_GROUPS_SELECT))
def market_groups_all_keys(spark, sf):
    return market.compare_market(items(spark, sf), dedup="none").groups.select(*_GROUP_COLUMNS)


_PRICE_COLUMNS = [
    "level", "key", "platform", "total_raw", "total", "mean", "median", "trimmed_mean", "cv", "p25", "p75",
    "awarded", "estimated", "mean_discount", "price_source",
]


@query("D12_group_platform_stats", _groups_none(f"\nSELECT {', '.join(_PRICE_COLUMNS)} FROM prices"))
def group_platform_stats(spark, sf):
    return market.compare_market(items(spark, sf), dedup="none").prices.select(*_PRICE_COLUMNS)


@query("D16_platform_scoreboard", _groups_none(_BOARD_SELECT))
def scoreboard(spark, sf):
    return market.compare_market(items(spark, sf), dedup="none").platforms


@query(
    "D14_comparability_score",
    _groups_none("\nSELECT level, key, score, band FROM banded"),
)
def comparability_scores(spark, sf):
    observed = market.observe_items(items(spark, sf))
    groups = market.group_table(market.platform_base(market.key_items(observed)))
    return market.group_scale_ok(groups).select("level", "key", "score", "band")


_RANKED = f"""WITH {_SETS}, g AS (SELECT l_partkey, platform, {r('m')} AS mean FROM base)"""


def _ranked(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn(
        "platform", F.concat(F.lit("P"), (F.col("l_suppkey") % 7).cast("string"))
    )
    means = rows.groupBy("l_partkey", "platform").agg(round_to(F.avg("l_extendedprice")).alias("mean"))
    return rank_in_group(means, ["l_partkey"], "mean", "platform")


@query(
    "W1_rank_in_group",
    f"{_RANKED} SELECT l_partkey, platform, mean, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY mean, platform) AS INTEGER) AS rank FROM g",
)
def ranks(spark, sf):
    return _ranked(spark, sf).select("l_partkey", "platform", "mean", "rank")


@query(
    "W2_winner_flags",
    f"""{_RANKED}, f AS (SELECT platform, row_number() OVER (PARTITION BY l_partkey ORDER BY mean, platform) AS rk FROM g)
SELECT platform, count(*) AS groups, count(*) FILTER (rk = 1) AS wins FROM f GROUP BY platform""",
)
def winners(spark, sf):
    from bidscope.operators.groups import winner_flags

    flagged = winner_flags(
        _ranked(spark, sf).withColumns({"score": F.lit(80.0), "band": F.lit("alta")}), "score", "band"
    )
    return flagged.groupBy("platform").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("win").alias("wins")
    )


@query(
    "W3_delta_to_leader",
    f"""{_RANKED}, d AS (SELECT *, min(mean) OVER (PARTITION BY l_partkey) AS lo FROM g)
SELECT l_partkey, platform, {r('least((mean - lo) / lo * 100, 500.0)')} AS delta FROM d""",
)
def deltas(spark, sf):
    return _ranked(spark, sf).select(
        "l_partkey", "platform", round_to(F.col("delta_to_leader")).alias("delta")
    )


@query(
    "W6_saving_vs_dearest",
    f"""{_RANKED}, d AS (SELECT *, max(mean) OVER (PARTITION BY l_partkey) AS hi,
    count(*) OVER (PARTITION BY l_partkey) AS n FROM g)
SELECT l_partkey, platform, CASE WHEN n >= 2 THEN {r('(1 - mean / hi) * 100', 1)} END AS saving FROM d""",
)
def savings(spark, sf):
    return _ranked(spark, sf).select(
        "l_partkey", "platform", F.col("saving_vs_dearest").alias("saving")
    )


_PLATFORM_SETS = """line AS (SELECT l_suppkey % 45 AS platform, 'ncm:' || p_brand || p_size || '/' || l_linenumber AS exact,
    'ncm4:' || p_brand || p_size AS four, 'desc:' || p_name || l_returnflag || l_linenumber || '/' || year(l_shipdate) AS lex
  FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT key, bit_or(CAST(1 AS BIGINT) << platform) AS m FROM (
    SELECT exact AS key, platform FROM line UNION ALL SELECT four, platform FROM line UNION ALL SELECT lex, platform FROM line) GROUP BY key),
s AS (SELECT *, bit_count(m) AS n, split_part(key, ':', 1) AS kind FROM g),
probe AS (SELECT DISTINCT kind, m, n FROM s WHERE kind <> 'ncm'), cover AS (SELECT DISTINCT kind, m FROM s WHERE kind <> 'desc' AND n >= 2),
gone AS (SELECT * FROM probe p WHERE EXISTS (SELECT 1 FROM cover c WHERE bit_count(p.m & c.m) * 2 >= p.n AND (p.kind = 'desc' OR c.kind = 'ncm')))"""


@query(
    "J16_redundant_groups",
    f"WITH {_PLATFORM_SETS} SELECT key, CAST(s.n AS INTEGER) AS platforms FROM s JOIN gone USING (kind, m)",
)
def redundant(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    size = F.concat("p_brand", F.col("p_size").cast("string"))
    number = F.col("l_linenumber").cast("string")
    keys = F.array(
        F.concat(F.lit("ncm:"), size, F.lit("/"), number), F.concat(F.lit("ncm4:"), size),
        F.concat(F.lit("desc:"), "p_name", "l_returnflag", number, F.lit("/"), F.year("l_shipdate").cast("string")),
    )
    keyed = rows.select(F.concat(F.lit("P"), (F.col("l_suppkey") % 45).cast("string")).alias("platform"), F.explode(keys).alias("key"))
    groups = stage(keyed.groupBy("key").agg(F.collect_set("platform").alias("platforms")), "platform-groups")
    gone = redundant_groups(groups, [], "key", "platforms")
    return groups.join(gone, "key", "left_semi").select("key", F.size("platforms").alias("platforms"))


@query(
    "D13_group_unit",
    f"""WITH {PLAIN_ITEM_SQL}, u AS (SELECT description, CASE unit WHEN 'un' THEN 'pc' ELSE unit END AS cu, count(*) AS n
  FROM item GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY n DESC, cu) AS rk,
    sum(n) OVER (PARTITION BY description) AS total FROM u)
SELECT description, cu AS unit, {r('n / total')} AS unit_rate, CAST(total AS BIGINT) AS total FROM m WHERE rk = 1""",
)
def units_of_groups(spark, sf):
    return group_unit(items(spark, sf, with_state=False), ["description"], "unit")


@query(
    "H28_humanize_key",
    f"""WITH {PLAIN_ITEM_SQL}, k AS (SELECT DISTINCT code, description, unit FROM item)
SELECT code, description, unit, 'NCM ' || (CASE WHEN length(code) >= 6 THEN code[1:4] || '.' || code[5:6] ELSE code END)
  || ' — ' || description || ' — ' || upper(unit) AS label,
  description || ' — ' || upper(unit) AS lexical_label FROM k""",
)
def key_labels(spark, sf):
    rows = items(spark, sf, with_state=False).select("code", "description", "unit").distinct()
    exact = F.concat_ws(":", F.lit("ncm"), "code", "unit")
    lexical = F.concat_ws(":", F.lit("desc"), "description", "unit")
    return rows.select(
        "*",
        humanize_key(exact, F.col("description")).alias("label"),
        humanize_key(lexical, F.col("description")).alias("lexical_label"),
    )
