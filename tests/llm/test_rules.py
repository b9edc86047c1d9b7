import numpy as np
import pytest
from pyspark.sql import functions as F

from bidscope.llm import robust_rules as rules, site_posteriors
from tests.llm import plain

SF = "/root/testdata/sf0.01"


def plain_verdicts(rows):
    """The same method on arrays: (doc_id, text) to kept; rows are (doc_id, text, language, source)."""
    stats = np.array([plain.statistics(t) for _, t, _, _ in rows], float)
    n, chars, symbols, lines, repeats = stats.T
    failed = (n < 50) | (100 * repeats > 50 * n)
    safe = np.maximum(n, 1)
    rate = lambda x: np.log1p(100 * x / safe)
    exact = np.stack([np.log(np.maximum(chars, 1) / safe), rate(symbols), rate(lines), repeats / safe], 1)
    x = np.floor(100 * exact + 0.5)
    own = [(a, b) for _, _, a, b in rows]
    sizes = {g: sum(1 for k, f in zip(own, failed) if k == g and not f) for g in set(own)}
    pooled = {a: sum(s for (l, _), s in sizes.items() if l == a and 0 < s < rules.MIN_GROUP) for a, _ in sizes}
    group = [g if sizes[g] >= rules.MIN_GROUP else g[:1] if pooled[g[0]] >= rules.MIN_GROUP else () for g in own]
    floor = np.array(rules.SMALLEST_SPREAD)
    kept, distances = ~failed, np.full(len(rows), np.nan)
    for g in set(group):
        member = np.array([k == g for k in group]) & ~failed
        if not member.any():
            continue
        rows_x = x[member]

        def moments(part, factor):
            m = part.mean(0)
            cov = factor * (part.T @ part / len(part) - np.outer(m, m))
            np.fill_diagonal(cov, np.maximum(cov.diagonal(), floor**2))
            return m, np.linalg.cholesky(cov)

        def distance(m, low, rows_x=rows_x):
            return (np.linalg.solve(low, (rows_x - m).T) ** 2).sum(0)

        def step(m, low, share=rules.SUBSET, rows_x=rows_x, moments=moments, distance=distance):
            band = np.floor(32 * np.log1p(distance(m, low)))
            values, counts = np.unique(band, return_counts=True)
            below = np.cumsum(counts) - counts
            return moments(rows_x[np.isin(band, values[below < share * len(rows_x)])], rules.SUBSET_FACTOR)

        ordered = np.sort(rows_x, axis=0)
        at = lambda q, o=ordered: o[int(np.ceil(q * len(o))) - 1]
        middle = at(0.5), np.diag(np.maximum((at(0.75) - at(0.25)) / 1.349, floor))
        ends = []
        for start in (middle, step(*middle, share=0.5), moments(rows_x, rules.SUBSET_FACTOR)):
            now, det = step(*start), lambda e: 2 * np.log(e[1].diagonal()).sum()
            while det(after := step(*now)) < det(now) - rules.FALLING:
                now = after
            ends.append(now)
        m, low = min(ends, key=det)
        m, low = moments(rows_x[distance(m, low) <= rules.REWEIGHT], rules.REWEIGHT_FACTOR)
        distances[member] = distance(m, low)
        kept[member] = distances[member] <= rules.MAX_DISTANCE
    return stats.astype(int), failed, kept, distances


def test_statistics_of_odd_documents(odd_docs, odd_rows, no_docs):
    got = rules.text_statistics(odd_docs, "key").collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain.statistics(odd_rows[r["key"]][1])
    assert rules.quality_rules(no_docs).count() == 0


def test_verdicts_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(rules, "MIN_GROUP", 40)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    stats, failed, kept, distances = plain_verdicts(rows)
    got = {r["doc_id"]: r for r in rules.quality_rules(docs).collect()}
    for k, (i, *_) in enumerate(rows):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == tuple(stats[k])
        assert (r["base_failed"], r["kept"]) == (failed[k], kept[k])
        assert (r["distance"] is None) == failed[k]
        if not failed[k]:
            assert r["distance"] == pytest.approx(distances[k], abs=0.01)


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.quality_rules(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in rows.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.1


def test_kept_documents_keep_their_columns(odd_docs):
    kept = rules.keep_good(odd_docs)
    assert kept.schema.names == odd_docs.schema.names
    short = {(r["doc_id"], r["text"]) for r in odd_docs.collect() if plain.statistics(r["text"])[0] < 50}
    rows = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert short and rows and not short & rows


def test_quality_on_documents_the_classifier_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    held_out = labels.join(seen, "doc_id", "left_anti")
    rows = site_posteriors.score(docs, seen).join(held_out, "doc_id").select("kept", "quality").collect()
    assert len(rows) > 100
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) / len(rows) > 0.95


def test_sparse_sites_stay_near_the_rate_above(spark):
    rows = [(i, "word " * 60 + f"text{i}", "en", "large") for i in range(200)] + [(1000, "#$% " * 60, "en", "tiny"), (1001, "word " * 60 + "x", "en", "tiny")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, source string, evidence int")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(1000, 0), (5, None)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in site_posteriors.score(docs, labels).collect()}
    assert len(got) == 202 and 0 < got[1001]["site_rate"] < 1 and got[0]["site_rate"] >= got[1001]["site_rate"]


def test_odd_documents_are_scored(odd_docs, odd_rows, no_docs, spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(50)], "doc_id bigint, quality int")
    assert site_posteriors.score(odd_docs, labels).count() == len(odd_rows)
    assert site_posteriors.score(odd_docs, labels.filter("false")).filter("posterior is null").count() == 0
    assert site_posteriors.score(no_docs, labels).count() == 0


def test_repeats_and_repeated_lines_reject_by_themselves(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: [f"w{k:04d}" for k in rng.choice(10_000, n, replace=False)]
    lines = lambda words, n: " ".join(words[n:]) + "".join(f"\n{w}\nx0000" for w in words[:n])
    texts = [" ".join(draw(100)) for _ in range(300)]
    phrase = draw(15)
    texts += [" ".join([*phrase, *draw(20), *phrase, *draw(35), *phrase])]  # 45 of 100 words repeated
    texts += [lines(draw(90), 10)]  # 9 repeated lines in 100 words
    texts += [lines(draw(98), 2)]  # one
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    rows = rules.quality_rules(docs).collect()
    assert not any(r["base_failed"] for r in rows)
    assert {r["doc_id"] for r in rows if not r["kept"]} == {300, 301}
