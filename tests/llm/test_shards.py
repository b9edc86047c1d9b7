import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from bidscope.llm import extendible


def test_every_shard_fits_and_is_a_prefix(odd_docs, odd_rows, no_docs):
    rows = extendible.shard(odd_docs, keys=["doc_id"], keep=["doc_id", "key"], limit=2_500).collect()
    assert sorted(r["key"] for r in rows) == list(range(len(odd_rows)))
    held = defaultdict(list)
    for r in rows:
        size = len((odd_rows[r["key"]][1] or "").encode())
        assert r["n_bytes"] == size and len(r["shard"]) == r["shard_depth"]
        held[r["shard"]].append((size, r["shard_bytes"], r["shard_rows"]))
    for sizes in held.values():
        assert sum(s for s, _, _ in sizes) == sizes[0][1] and len(sizes) == sizes[0][2]
        assert sizes[0][1] <= 2_500 or len(sizes) == 1
    names = sorted(held)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    # Only what was too large was split: a shard and its sibling would not fit together.
    for name in names:
        sibling = name[:-1] + "10"[int(name[-1])]
        if sibling in held:
            assert held[name][0][1] + held[sibling][0][1] > 2_500
    assert extendible.shard(no_docs, keys=["doc_id"], keep=["doc_id"]).count() == 0


def test_a_key_that_is_too_large_is_split_by_rows(spark):
    docs = spark.createDataFrame([(1, "x" * 100 + str(i)) for i in range(100)], "source int, text string")
    rows = extendible.shard(docs, keys=["source"], keep=["source"], limit=1_000).collect()
    assert len(rows) == 100 and max(r["shard_bytes"] for r in rows) <= 1_000 and min(r["shard_depth"] for r in rows) > 64


def test_no_window_holds_cells_of_more_than_some_levels(spark, monkeypatch):
    rng = random.Random(8)
    # Halves of the bits are filled unevenly, so that buckets end at many depths.
    rows = [("".join("1" if rng.random() < 0.7 else "0" for _ in range(128)), rng.randint(1, 9)) for _ in range(3_000)]
    limit, want = 60, set()

    def split(prefix, inside):
        if not inside:
            return
        size = sum(b for _, b in inside)
        if size <= limit or len(inside) == 1:
            want.add((prefix, len(prefix), size, len(inside)))
            return
        for bit in "01":
            split(prefix + bit, [r for r in inside if r[0].startswith(prefix + bit)])

    split("", rows)
    spans = []

    def watched(df, name, stage=extendible.stage):
        out = stage(df, name)
        if name == "directory":
            depths = [int(d) for d in re.findall(r"substring\(_cell#\d+, 1, (\d+)\)", df._jdf.queryExecution().analyzed().toString())]
            spans.append(out.agg(F.max(F.length("_cell"))).first()[0] - min(depths))
        return out

    monkeypatch.setattr(extendible, "stage", watched)
    df = spark.createDataFrame(rows, "_path string, _bytes bigint")
    assert {tuple(r) for r in extendible.directory(df, limit).collect()} == want
    assert len(spans) > 2 and max(spans) <= extendible.LEVELS
