import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from bidscope.llm import periodic


def plain_runs(words, least):
    """By the definition, every period by itself."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    w, out = np.array([number[x] for x in words], np.int64), []
    for q in range(1, len(words) // 3 + 1):
        same = np.concatenate([[0], w[q:] == w[:-q], [0]]).astype(np.int8)
        for start, end in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            own = w[start : end + q]
            if len(own) >= max(least, 3 * q) and not any((own[d:] == own[:-d]).all() for d in range(1, q)):
                out.append((int(start), len(own), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 24)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    milli = 1000 * best[1] // best[2] if found else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def some_words(rng):
    letters = rng.choice([1, 2, 3, 5])
    words = [rng.randrange(letters) for _ in range(rng.randint(0, 80))]
    for _ in range(rng.randint(0, 4)):
        at, block = rng.randint(0, len(words)), [rng.randrange(letters + 3) for _ in range(rng.randint(1, 12))]
        words[at:at] = (block * 60)[: rng.randint(len(block), 60)]
    return words


@pytest.mark.parametrize("least", [24, 3])
def test_runs_equal_the_definitions(least):
    rng = random.Random(3)
    for _ in range(800):
        words = some_words(rng)
        got = periodic.runs(np.array(words, np.int64), len(words), least)
        assert [tuple(x) for x in got.tolist()] == plain_runs(words, least)


def test_hot_words_take_no_longer():
    n = 300_000
    assert periodic.runs(np.zeros(n, np.int64), n).tolist() == [[0, n, 1]]
    assert periodic.runs(np.arange(n) % 30_011, n).tolist() == [[0, n, 30_011]]
    assert not len(periodic.runs(np.arange(n), n))


def test_too_few_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(9, np.int64), 9, 2, 2)


@pytest.mark.parametrize("slice_words", [1 << 18, 50])
def test_documents(spark, odd_docs, odd_rows, no_docs, monkeypatch, slice_words):
    rng = random.Random(7)
    rows = odd_rows + [(1000 + k, " ".join(f"w{x}" for x in some_words(rng))) for k in range(200)]
    rows += [(5000, "a b a b " * 3 + "x" + " c d e" * 30 + " y" + " same" * 40)]
    docs = odd_docs.select("doc_id", "text", "key").unionByName(
        spark.createDataFrame([(*r, 0) for r in rows[len(odd_rows) :]], "doc_id bigint, text string, key int")
    )
    monkeypatch.setattr(periodic, "SLICE_WORDS", slice_words)
    got = [tuple(r) for r in periodic.digests(docs).collect()]
    want = [plain_row(*r) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] for r in got) > 20
    assert periodic.digests(no_docs).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = [plain_row(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 8000]
    got = {r["doc_id"]: tuple(r) for r in periodic.digests(docs).collect()}
    assert all(got[r[0]] == r for r in want) and len(got) == docs.count()


def test_texts_without_repetitions(odd_docs, no_docs):
    before = {(r["key"]): r for r in odd_docs.collect()}
    for r in periodic.without_repetitions(odd_docs).collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode())
        assert r["text"] == before[r["key"]]["text"] or not plain_runs(words, 24)
    assert {r["key"]: r["text"] for r in periodic.without_repetitions(odd_docs).collect()}[135] == "same"
    assert periodic.without_repetitions(no_docs).count() == 0
    runs = {r["key"]: [tuple(x) for x in r["spans"]] for r in periodic.runs_of(odd_docs, name="spans").collect()}
    assert runs[135] == [(0, 90, 1)] and runs[140] == []
