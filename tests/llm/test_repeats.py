import hashlib
from collections import Counter

import pyarrow as pa
import pytest

from bidscope.llm import automata, repeats, suffix_sort
from bidscope.llm.repeats import Shard, Windows
from tests.llm import plain

SMALL_WORDS = Windows(unit="words", size=6, gram=3, keep_first=True, shard_units=500)
SMALL_BYTES = Windows(unit="bytes", size=40, gram=16, keep_first=False, shard_units=2_000)


def marked(found, kind):
    """(doc_id, text) with the covered units, per row of the result."""
    out = []
    for r in found.select("doc_id", "text", "spans").collect():
        units = (r["text"] or "").encode()
        units = plain.WORD.findall(units) if kind == "words" else units
        gone = repeats.removed_mask(len(units), r["spans"])
        out.append(((plain.NO_ID if r["doc_id"] is None else r["doc_id"], r["text"] or ""), gone.tolist()))
    return out


@pytest.mark.parametrize("group", [2_048, 3])
def test_words_that_stand_earlier(odd_docs, odd_rows, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_CONTEXTS", group)
    want = plain.earlier_words(odd_rows, 6)
    got = marked(automata.remove_repeats(odd_docs.select("doc_id", "text"), SMALL_WORDS), "words")
    assert len(got) == len(odd_rows)
    assert all(gone == want[doc][1] for doc, gone in got)
    assert sum(map(sum, (g for _, g in got))) > 1000


@pytest.mark.parametrize("group", [2_048, 3])
def test_bytes_that_stand_elsewhere(odd_docs, odd_rows, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_CONTEXTS", group)
    want = plain.shared_bytes(odd_rows, 40)
    got = marked(suffix_sort.find_repeats(odd_docs.select("doc_id", "text"), SMALL_BYTES), "bytes")
    assert len(got) == len(odd_rows)
    assert all(gone == want[doc][1] for doc, gone in got)


def test_digests_use_the_production_windows(odd_docs, odd_rows):
    words = plain.earlier_words(odd_rows, 20)
    for r in automata.digests(odd_docs).collect():
        possible = [v for (i, _), v in words.items() if i == (plain.NO_ID if r["doc_id"] is None else r["doc_id"])]
        sums = {hashlib.sha256(b" ".join(w for w, g in zip(*v) if not g)).hexdigest(): v for v in possible}
        assert r["n_words"] == len(sums[r["kept_sha256"]][0]) and r["n_removed"] == sum(sums[r["kept_sha256"]][1])


def test_no_documents(no_docs):
    assert automata.digests(no_docs).count() == 0
    assert suffix_sort.digests(no_docs).count() == 0


def test_cut_texts_keep_all_columns_and_whole_characters(odd_docs):
    found = suffix_sort.without_repeats(odd_docs)
    assert found.schema.names == odd_docs.schema.names
    before, after = (Counter((r["_rest"], r["key"], r["spans"]) for r in d.collect()) for d in (odd_docs, found))
    assert before == after
    assert suffix_sort.kept_text("aéb", [{"start": 2, "stop": 3}]) == "ab"


def test_a_long_key_streams_in_pieces(odd_docs, monkeypatch):
    monkeypatch.setattr(repeats, "OPEN_ROWS", 2)
    # The workers must see the small limit, so the streaming step runs here.
    _, texts = repeats.identified(odd_docs.select("doc_id", "text"))
    docs = texts.toPandas()
    batches = [pa.RecordBatch.from_pandas(docs.iloc[i : i + 20], preserve_index=False) for i in range(0, len(docs), 20)]
    for windows in (SMALL_WORDS, SMALL_BYTES):
        rows = pa.Table.from_batches(list(repeats._contexts(windows)(iter(batches)))).sort_by([(c, "ascending") for c in ("key", "content", "doc", "copy", "place")])
        small = pa.Table.from_batches(list(repeats._settle(windows)(iter(rows.to_batches(max_chunksize=3)))))
        monkeypatch.setattr(repeats, "OPEN_ROWS", 1 << 19)
        whole = pa.Table.from_batches(list(repeats._settle(windows)(iter(rows.to_batches()))))
        monkeypatch.setattr(repeats, "OPEN_ROWS", 2)

        def covered(found):
            out = Counter()
            for r in found.filter(pa.compute.is_null(found["key"])).to_pylist():
                out.update({(r["doc"], r["copy"], k) for k in range(r["start"], r["stop"])} - set(out))
            return set(out)

        assert covered(small) == covered(whole)
        keyed = [sorted((r["key"], r["doc"], r["start"]) for r in t.to_pylist() if r["key"] is not None) for t in (small, whole)]
        assert keyed[0] == keyed[1]


def test_automaton_and_sort_on_one_shard():
    import numpy as np

    bodies = [b"a b c d e f a b c d", b"x a b c d y", b"c d e f"]
    shard = Shard(bodies, np.arange(3), np.zeros(3), np.zeros(3))
    which, start, stop = automata.earlier_windows(shard, 4)
    assert list(zip(which, start, stop)) == [(0, 6, 10), (1, 1, 5), (2, 0, 4)]
    s = suffix_sort.Suffixes([b"banana", b"ananas", b"", b"nab"])
    at = np.arange(len(s.data))
    want = sorted(at, key=lambda i: (s.raw[i : s.end(np.array([i]))[0]], i))
    assert s.sort(at).tolist() == want
