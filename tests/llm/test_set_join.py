from collections import Counter

import pytest

from bidscope.llm import set_join
from tests.llm import plain


def node(doc_id, text):
    return plain.NO_ID if doc_id is None else doc_id, text or ""


@pytest.mark.parametrize("block", [1 << 21, 200])
def test_components(odd_docs, odd_rows, block, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK_SHINGLES", block)
    want = plain.components(odd_rows)
    rows = set_join.jaccard_components(odd_docs).collect()
    expected = Counter((i, n, None if c == plain.NO_ID else c) for i, t in odd_rows for n, c, _ in [want[node(i, t)]])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == expected


def test_one_document_of_each_stays(odd_docs, odd_rows, no_docs):
    want = plain.components(odd_rows)
    kept = set_join.one_of_each(odd_docs)
    assert kept.schema.names == odd_docs.schema.names
    rows = kept.collect()
    groups = Counter(want[node(r["doc_id"], r["text"])][2] for r in rows)
    assert groups == Counter({number: 1 for _, _, number in want.values()})
    assert all(node(r["doc_id"], "")[0] == want[node(r["doc_id"], r["text"])][1] for r in rows)
    assert set_join.one_of_each(no_docs).count() == 0
    assert set_join.jaccard_components(no_docs).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 99)], "a bigint, b bigint")
    found = {r["doc"]: r["component"] for r in set_join.components(edges).collect()}
    assert found == {i: 0 for i in range(51)} | {99: 99, 100: 99}
