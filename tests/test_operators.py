import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bidscope.operators import groups as group_operators, matching, search, skew, tables
from bidscope.operators.groups import redundant_groups
from bidscope.operators.joins import items_with_awards_nested, notice_items
from bidscope.operators.matching import keyword_hits
from bidscope.operators.tables import replace_partitions, upsert_by_key
from bidscope.plans.prospect import notices_with_code


def test_previous_values_equal_a_plain_lag(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = [(rng.choice("ab"), start + dt.timedelta(hours=rng.randint(0, 400)), i, rng.choice(["x", "y", None])) for i in range(300)]
    rows = spark.createDataFrame(data, "k string, t timestamp, i int, s string")
    got = {r["i"]: (r["has_previous"], r["previous_s"]) for r in skew.previous_values(rows, ["k"], F.date_trunc("day", "t"), ["t", "i"], ["s"]).collect()}
    wanted = {}
    for key in "ab":
        before = None
        for _, t, i, s in sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2])):
            wanted[i] = (before is not None, before[0] if before else None)
            before = (s,)
    assert got == wanted


@pytest.mark.parametrize("shard", [50_000, 1, 3])
def test_keyword_hits_equal_a_plain_search(spark, monkeypatch, shard):
    monkeypatch.setattr(matching, "SHARD_KEYWORDS", shard)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ab ç", k=rng.randint(0, 12)))) for i in range(150)]
    rows += [(200, "software de gestao"), (201, "e mail"), (202, None), (203, ""), (204, "software de gestao")]
    words = {"".join(rng.choices("ab ç", k=rng.randint(1, 4))) for _ in range(30)} | {"soft", "gest", "e", "a b", "software de gestao"}
    texts = spark.createDataFrame(rows, "id int, norm string").repartition(3)
    keywords = spark.createDataFrame([(w,) for w in [*words, *words, "", None]], "keyword string")
    got = sorted(map(tuple, keyword_hits(texts, keywords, ["id"]).collect()))
    assert got == sorted((i, w) for i, t in rows for w in words if t and w in t)
    assert keyword_hits(texts, keywords.filter("false"), ["id"]).count() == keyword_hits(texts.filter("false"), keywords, ["id"]).count() == 0


def test_keyword_hits_of_raw_texts(spark):
    texts = spark.createDataFrame([(1, "AQUISIÇÃO de Cadeiras"), (2, None)], "id int, description string")
    keywords = spark.createDataFrame([("aquisicao",), ("cadeira",), ("mesa",)], "keyword string")
    got = keyword_hits(texts, keywords, ["id"], "description", is_normal=False).collect()
    assert sorted(map(tuple, got)) == [(1, "aquisicao"), (1, "cadeira")]


def test_chunks_hold_every_row_of_a_hot_key(spark):
    rows = spark.range(2500).select(F.when(F.col("id") < 2400, "hot").otherwise("cold").alias("k"), "id")
    chunks = skew.collect_in_chunks(rows, ["k"], F.struct("id"), "members", F.col("id"), chunk_rows=500)
    got = chunks.select("k", F.size("members").alias("n")).collect()
    assert sum(r["n"] for r in got if r["k"] == "hot") == 2400
    assert max(r["n"] for r in got) < 800
    assert [r["n"] for r in got if r["k"] == "cold"] == [100]


def test_nested_awards_default_to_empty(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    awards = spark.createDataFrame([("a", 2.0), ("a", 1.0)], "item_id string, unit_award double")
    got = {r["item_id"]: [x["unit_award"] for x in r["awards"]] for r in items_with_awards_nested(items, awards).collect()}
    assert got == {"a": [1.0, 2.0], "b": []}


def test_notice_items_links_once(spark):
    notices = spark.createDataFrame([(1, "h1", "t", 2024, 5)], "notice_id int, notice_hash string, org_tax_id string, year int, sequence int")
    items = spark.createDataFrame(
        [("a", "h1", "t", 2024, 5), ("b", None, "t", 2024, 5), ("c", "h1", "x", 1, 1), ("d", None, "x", 1, 1)],
        "item_id string, notice_hash string, org_tax_id string, year int, sequence int",
    )
    got = sorted((r["item_id"], r["link"]) for r in notice_items(notices, items).collect())
    assert got == [("a", "hash"), ("b", "parts"), ("c", "hash")]


@pytest.mark.parametrize(("kinds", "most", "in_a_row"), [(10, 5, 4096), (45, 12, 3), (150, 40, 7)])
def test_redundant_groups_match_brute_force(spark, monkeypatch, kinds, most, in_a_row):
    monkeypatch.setattr(group_operators, "COVERS", in_a_row)
    rng = random.Random(11)
    groups = []
    for i in range(160):
        kind = rng.choice(["ncm", "ncm4", "desc"])
        groups.append((rng.choice(["x", "y", None]), f"{kind}:{i}", rng.sample([f"P{k}" for k in range(kinds)], rng.randint(0, most))))
    groups += groups[:9]
    df = spark.createDataFrame(groups, "level string, key string, platforms array<string>")
    got = {(r["level"], r["key"]) for r in redundant_groups(df, ["level"], "key", "platforms").collect()}

    def falls(level, key, plats):
        kind = key.split(":")[0]
        better = {"desc": ("ncm", "ncm4"), "ncm4": ("ncm",)}.get(kind, ())
        return any(
            lv == level and k.split(":")[0] in better and len(p) >= 2 and len(set(p) & set(plats)) >= len(plats) * 0.5
            for lv, k, p in groups
        )

    want = {(lv, k) for lv, k, p in groups if falls(lv, k, p)}
    assert got == want and 0 < len(want) < len(groups)
    assert redundant_groups(df.filter("false"), ["level"], "key", "platforms").count() == 0


def test_redundant_groups_of_many_sets(spark):
    """8,000 different sets of up to 45 platforms, none of which covers half of a term group's but one."""
    platforms = F.transform(F.sequence(F.lit(0), F.lit(44)), lambda k: F.when(F.rand(3) < F.rand(4), k.cast("string")))
    sets = spark.range(8000).select(
        F.concat(F.when(F.col("id") % 2 == 0, "ncm:").otherwise("desc:"), F.col("id").cast("string")).alias("key"),
        F.array_compact(platforms).alias("platforms"),
    )
    groups = spark.createDataFrame(sets.collect(), sets.schema)
    got = {r["key"] for r in redundant_groups(groups, [], "key", "platforms").collect()}
    rows = [(r["key"], sum(1 << int(p) for p in r["platforms"])) for r in groups.collect()]
    covers = [m for k, m in rows if k.startswith("ncm:") and m.bit_count() >= 2]
    assert got == {k for k, m in rows if k.startswith("desc:") and any((m & c).bit_count() * 2 >= m.bit_count() for c in covers)}


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    incoming = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    once = upsert_by_key(target, incoming, ["k"], [F.col("v")])
    twice = upsert_by_key(once, incoming, ["k"], [F.col("v")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "c"), (3, "e")]


def test_replace_partitions_touches_only_its_own(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_partitions(spark.createDataFrame([(1, "x"), (2, "y")], "v int, state string"), path, ["state"])
    replace_partitions(spark.createDataFrame([(9, "x")], "v int, state string"), path, ["state"])
    got = sorted((r["state"], r["v"]) for r in spark.read.parquet(path).collect())
    assert got == [("x", 9), ("y", 2)]


def test_seek_pages_walk_all_rows_in_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1.0, 2.0, 2.5]), rng.choice([None, "a", "b"]), k) for k in range(60)]
    df = spark.createDataFrame(rows, "score double, town string, k int")
    for order in ([("score", True), ("k", False)], [("score", False), ("town", True), ("k", True)], [("town", True), ("score", False), ("k", False)]):
        sorts = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]
        want, got, after = [r["k"] for r in df.orderBy(*sorts).collect()], [], None
        while part := search.seek_page(df, order, 13, after).collect():
            got += [r["k"] for r in part]
            after = part[-1]
        assert got == want
    assert search.seek_page(df.filter("false"), [("k", False)], 5).count() == 0


def test_code_targets(spark):
    items = spark.createDataFrame(
        [(1, "ABCDE"), (1, "ABX"), (2, "AB"), (3, ""), (4, None), (5, "ÁBC"), (6, "A")], "notice_id INT, code STRING"
    )
    targets = spark.createDataFrame([(7, "AB"), (7, "ABX"), (8, "ABCDEF"), (8, "Á"), (9, "A")], "org_id INT, target STRING")
    found = sorted(map(tuple, notices_with_code(items, targets).collect()))
    assert found == [(7, 1), (7, 2), (8, 5), (9, 1), (9, 2), (9, 6)]
    assert notices_with_code(items, targets.limit(0)).count() == 0


def _geo(spark, items):
    schema = "item_no int, notice_hash string, org_tax_id string, ibge_code string, state string, municipality string"
    notices = spark.createDataFrame(
        [("h1", "A", 1, 5), ("h2", "A", 2, 3), ("h3", "B", 2, 1), (None, "C", 1, 1), ("h4", "B", None, 0)],
        "notice_hash string, org_tax_id string, municipality_id int, published_at int",
    )
    places = spark.createDataFrame([(1, "10", "SP", "x"), (2, "20", "RJ", "y")], "municipality_id int, ibge_code string, state string, name string")
    return tables.backfill_geo(spark.createDataFrame(items, schema), notices, places)


def test_geo_by_hash_then_by_organisation(spark):
    items = [
        (1, "h1", "A", None, None, None), (2, None, "A", None, "MG", None), (3, "#1", "A", None, None, None), (4, None, None, None, None, None),
        (5, "h1", "A", "?", None, None), (6, "h2", None, None, None, "z"), (7, "h4", "B", None, None, None), (8, None, "C", None, None, None),
        (9, None, "none", None, None, None),
    ]
    got = {r["item_no"]: (r["ibge_code"], r["state"], r["municipality"]) for r in _geo(spark, items).collect()}
    assert got == {
        1: ("10", "SP", "x"), 2: ("20", "MG", "y"), 3: ("20", "RJ", "y"), 4: (None, None, None), 5: ("?", None, None),
        6: ("20", "RJ", "z"), 7: ("20", "RJ", "y"), 8: ("10", "SP", "x"), 9: (None, None, None),
    }


def test_items_that_look_nothing_up_are_dealt_over_the_tasks(spark):
    items = [(i, None, None if i % 2 else "A", None if i % 2 else "?", None, None) for i in range(2000)]
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        # a join whose columns nobody reads would be left out
        task = F.spark_partition_id().alias("task")
        rows = _geo(spark, items).groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.max("ibge_code"), F.max("state")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["n"] for r in rows) == 2000
    assert max(r["n"] for r in rows) < 700  # of 4 tasks


def test_notice_items_of_both_links_read_their_inputs_once(spark):
    rng = random.Random(2)
    kinds = "notice_hash string, org_tax_id string, year int, sequence long"

    def some(n):
        return [(i, rng.choice(["h1", "h2", "1:t:1:1", None]), rng.choice(["t", "t:1", "", None]), rng.choice([1, 11, None]), rng.choice([1, 2, None])) for i in range(n)]

    notices, items = some(60), some(80)
    found = notice_items(
        spark.createDataFrame(notices, f"notice_id int, {kinds}"),
        spark.createDataFrame([(f"i{i}", *r) for i, *r in items], f"item_id string, {kinds.replace('int', 'long')}"),
    )
    assert found.columns == ["item_id", "notice_id", "notice_hash", "org_tax_id", "year", "sequence", "link"]
    want = []
    for i, h, *parts in items:
        for n, nh, *nparts in notices:
            by_hash, by_parts = h is not None and h == nh, None not in parts and parts == nparts and parts[0] != ""
            if by_hash or by_parts:
                want.append((f"i{i}", n, nh, *nparts, "hash" if by_hash else "parts"))
    assert {r[-1] for r in want} == {"hash", "parts"}
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    # one shuffle of the items and one of the notices
    assert found.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
