import random
import re
import zlib
from collections import Counter

import pytest

from bidscope.llm import spelling


def one_edit(a, b):
    """Whether b comes from a by one inserted, deleted or replaced character."""
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    return any(a[:k] + a[k + (len(a) == len(b)) :] == b[:k] + b[k + 1 :] for k in range(len(b)))


def plain_words(rows):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def plain_variants(words, ratio=10):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(x, key=lambda y: (-words[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def changed(rng, word):
    k = rng.randrange(len(word) + 1)
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abé") + word[k:], word[:k] + "x" + word[k + 1 :]])


def some_words(seed, n=400):
    """Words with chains of misspellings, ties, one very common beginning and one very long word."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(7, 12))): rng.randint(2, 9) for _ in range(n // 4)}
    words |= {"general" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))): 10 ** rng.randint(1, 4) for _ in range(n // 4)}
    words |= {"y" * k: 10**6 for k in (7, 8, 300, 301)}
    while len(words) < n:
        w = rng.choice(list(words))
        x = changed(rng, w)
        if len(x) >= 7:
            words.setdefault(x, max(2, words[w] // rng.choice([1, 5, 10, 11])))
    return words


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize(("block_words", "tile"), [(512, 256), (8, 4), (2, 2)])
def test_variants_equal_all_pairs(spark, monkeypatch, block_words, tile):
    words = some_words(block_words)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(spelling, "TILE", tile)
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n bigint, block int").repartition(3)
    got, want = rows_of(spelling.variants(df)), plain_variants(words)
    assert got == want
    assert sum(1 for r in want if r[1] and r[1] != r[2]) > 5  # chains


def test_rows_are_compared_across_batches(spark, monkeypatch):
    words = some_words(9)
    monkeypatch.setattr(spelling, "HELD_ROWS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame(list(words.items()), "word string, n bigint")
        assert rows_of(spelling.variants(df)) == plain_variants(words)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    rng = random.Random(8)
    words = some_words(4, 120)
    texts = [" ".join(rng.choices(list(words), [min(n, 200) for n in words.values()], k=150)) for _ in range(30)]
    rows = odd_rows + [(2000 + k, t.title() if k % 3 else t) for k, t in enumerate(texts)]
    more = spark.createDataFrame(rows[len(odd_rows) :], "doc_id bigint, text string")
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 20)
    got = rows_of(spelling.groups(odd_docs.select("doc_id", "text").unionByName(more)))
    assert got == plain_variants(plain_words(rows))
    assert spelling.groups(no_docs).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = plain_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = rows_of(spelling.groups(docs))
    assert {(r[0], r[3]) for r in got} == set(words.items())
    some = sorted(words)[::40]
    want = {w: [x for x in words if one_edit(w, x)] for w in some}
    assert {r[0]: r[4] for r in got if r[0] in want} == {w: len(x) for w, x in want.items()}
