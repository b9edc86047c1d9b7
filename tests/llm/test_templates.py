import re

import pyarrow as pa
from pyspark.sql import functions as F

from bidscope.llm import templates

SF = "/root/testdata/sf0.01"
ITEM = "Alice has 12 apples and gives 5 apples to Bob before she walks 3 km to the old market near the river."


def found(text, items=((1, ITEM),)):
    bench = templates.benchmark_of(list(items))
    return list(templates._search(pa.array([text], pa.string()), bench))


def test_copies_and_questions_with_other_values():
    assert found(f"Before it. {ITEM} After it.")
    assert found(ITEM.upper().replace(" ", "\n"))
    assert found("So: Carol has 40 apples and gives 1,700 apples to Dora before she walks 8 km to the old market near the river.")
    text, item, _, size, slots, changed = found(ITEM.replace("Alice", "Eve"))[0]
    assert (text, item, slots, changed) == (0, 0, 6, 1) and size > 13


def test_other_texts_and_inconsistent_slots_stay():
    assert not found("Alice has apples and Bob walks to the old market, says a text about something else near the river.")
    assert not found(None) and not found("") and not found("Alice has 12 apples")
    pairs = ((2, "the city of Rom and the town of Ulm and the port of Kiel and the hill of Alba and the sea of Ross and the isle of Man"),)
    assert found(pairs[0][1], pairs)
    # The same name for each slot is no renaming of the item.
    assert not found(re.sub(r"[A-Z]\w+", "Rom", pairs[0][1]), pairs)


def test_whole_items_in_documents_are_found(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rows = docs.select("doc_id", "text").collect()
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    normal = [(i, words(t)) for i, t in items]
    planted = {r["doc_id"] for r in rows if any(t in words(r["text"]) for _, t in normal)}
    windows = {tuple(w[k : k + 8]) for _, t in normal for w in [t.split()] for k in range(len(w) - 7)}
    near = {r["doc_id"] for r in rows for w in [words(r["text"]).split()] if any(tuple(w[k : k + 8]) in windows for k in range(len(w) - 7))}
    got = {r["doc_id"] for r in templates.contaminations(docs, bench).collect()}
    assert planted and planted <= got <= near
    kept = templates.decontaminate(docs, bench)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in rows} - got


def test_odd_documents_and_blocks(odd_docs, odd_rows, no_docs, spark, monkeypatch):
    monkeypatch.setattr(templates, "BLOCK_BYTES", 100)
    spelled = lambda t: (t or "").translate(str.maketrans("0123456789", "abcdefghij"))
    docs = odd_docs.withColumn("text", F.translate("text", "0123456789", "abcdefghij"))
    items = [(1, spelled(odd_rows[4][1])), (5, spelled(odd_rows[11][1]))]
    bench = spark.createDataFrame([(*x, 0) for x in [*items, (2, None), (3, ""), (4, "too short")]], "item_id bigint, text string, n int")
    got = {(r["doc_id"], r["item_id"]) for r in templates.contaminations(docs, bench).collect()}
    want = {(i, k) for k, t in items for i, x in odd_rows if x and t.split() == spelled(x).split()}
    assert want and want <= got
    assert templates.contaminations(no_docs, bench).count() == 0
    assert templates.contaminations(odd_docs, bench.filter("false")).count() == 0
    assert templates.decontaminate(odd_docs, bench.filter("false")).count() == len(odd_rows)


def test_number_heavy_and_short_items_and_any_share_of_other_values():
    series = ((3, "Go on: 3 5 8 13 21 34 55 89 144 233 377 610 987 1597 and so on"), (4, "7 + 5 = 12"), (5, "Sums 1 2 3 4 5 6 7"))
    assert found(f"A text with this in it. {series[0][1]} 2584, it says.", series)
    assert not found("A text with 3 5 8 13 21 34 56 89 144 233 377 611 987 1597 in it.", series)
    assert [r[1] for r in found("Easy: 7 + 5 = 12! Hard is 17 + 5 = 12 here, or 7 + 5 = 12 apples.", series)] == [1]
    assert [r[1] for r in found("Before, sums 1 2 3 4 5 6 7 8", series)] == [2]
    trade = ((6, "Ann buys 3 kg of rice for 12 and Bob sells 2 kg of it for 9"),)
    assert found("So Eve buys 4 lb of rice for 15 and Max sells 5 lb of it for 7 today", trade)
    assert not found("So Eve buys 4 lb of tea for 15 or Max takes 5 lb of cake for 7 today", trade)


def test_values_of_another_number_of_words():
    other = "Mary Ann Lee has 4 apples and gives 9 apples to Old Tom Ray before she walks 5 feet 3 inches to the old market near the river."
    rows = found(f"here it goes, {other}")
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in rows] == [(0, 0, 3, 5, 5)]
    swapped = ((7, "when Ann met Bob Ray and Ann saw Bob Ray then Ann told Bob Ray that Ann knew Bob Ray and Ann left Bob Ray"),)
    assert found("when Eve Lu met Kim and Eve Lu saw Kim then Eve Lu told Kim that Eve Lu knew Kim and Eve Lu left Kim", swapped)
    assert not found("when Eve Lu met Kim and Kim saw Lu then Lu Kim told Eve that Eve Lu knew Kim Lu and Lu Eve left Lu", swapped)
