import random

import pytest
from pyspark.sql import functions as F

from bidscope.functions.text import trigram_similarity, trigrams
from bidscope.operators import text_index


def names(rng, n):
    parts = ["red", "blue", "green", "steel", "bolt", "bolts", "pump", "água", "x", "12"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(t, k) for k, t in enumerate([*names(random.Random(1), 150), None, "", " - ", "red bolt", "red bolt"])]
    return spark.createDataFrame(rows, "description string, term int")


@pytest.fixture(scope="module")
def index(texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    text_index.write_trigram_index(texts, "description", path)
    return path


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.8, 1.0])
def test_similar_texts_equal_a_comparison_of_all_pairs(spark, texts, index, threshold):
    asked = spark.createDataFrame([(t,) for t in [*names(random.Random(2), 40), None, "", "zzz", "red bolt", "red bolt"]], "ask string")
    got = text_index.similar_texts(spark, index, asked, "ask", threshold)
    one, two = asked.select("ask").distinct(), texts.select("description").distinct()
    value = trigram_similarity(trigrams(F.col("ask")), trigrams(F.col("description")))
    pairs = one.crossJoin(two).withColumn("similarity", value).filter(F.col("similarity") >= threshold)
    pairs = pairs.select(F.col("ask").alias("question"), text_index.text_key(F.col("description")).alias("key"), "similarity")
    show = lambda df: sorted((r["question"], bytes(r["key"]), round(r["similarity"], 9)) for r in df.collect())
    want = show(pairs)
    assert show(got) == want and want
    single = {(bytes(r["key"]), round(r["similarity"], 9)) for r in text_index.texts_like(spark, index, "red bolt", threshold).collect()}
    assert single == {(k, s) for q, k, s in want if q == "red bolt"}


def test_words_find_their_rows(spark, tmp_path):
    rows = [(1, "a b c"), (2, "a b"), (3, ""), (4, None), (None, "a c"), (5, "b b"), (5, "a"), (6, "ç a")]
    docs = spark.createDataFrame(rows, "n int, text string")
    path = str(tmp_path)
    text_index.write_index(docs, F.col("n"), F.split("text", " "), path, buckets=3)
    find = lambda *terms, mode="all": {r["key"] for r in text_index.keys_with_terms(spark, path, list(terms), mode, 3).collect()}
    assert find("a", "b") == {1, 2, 5} and find("a", "c") == {1, None} and find("a", "a", "ç") == {6}
    assert find("ç", "c", mode="any") == {1, None, 6}
    assert find("nowhere") == find("a", "nowhere") == find() == find(mode="any") == set()


def test_a_search_reads_only_the_folders_of_its_terms(spark, index):
    rows = text_index.postings(spark, index, ["red", "bol"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "bucket" in filters.split("]")[0] and "term" in plan[plan.index("PushedFilters") :]
    assert rows.count() == spark.read.parquet(f"{index}/postings").filter("term in ('red', 'bol')").count() > 0


def test_an_empty_table_has_an_empty_index(spark, texts, tmp_path):
    text_index.write_trigram_index(texts.filter("false"), "description", str(tmp_path))
    assert text_index.texts_like(spark, str(tmp_path), "red").count() == 0
    assert text_index.similar_texts(spark, str(tmp_path), texts, "description").count() == 0


def test_a_threshold_of_nothing_is_refused(spark, index):
    with pytest.raises(ValueError):
        text_index.texts_like(spark, index, "red", 0.0)


def test_terms_are_made_once_and_moved_once(texts):
    posted = text_index._posted(texts, F.col("term"), F.split("description", "[^a-z0-9]+"))
    plan = posted._jdf.queryExecution().optimizedPlan().toString()
    once = plan.count("split(")
    assert once == 1 and "Join" not in plan and plan.count("Aggregate") == 1
    got = {(r["key"], r["term"]): r["n"] for r in posted.collect()}
    assert got and all(n == sum(k == key for k, _ in got) for (key, _), n in got.items())
