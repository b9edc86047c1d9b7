import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bidscope.llm import suffix_sort, templates
from bidscope.session import stage
from tests.llm import plain
from tests.llm.test_rules import plain_verdicts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """What every stage makes of its predecessor's documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], SF), "stage"))
    return out


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_all_but_the_last_return_documents(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(x.schema.names == steps[0].schema.names for x in steps[:-1])


def test_quality_rules(steps):
    before = list(rows_of(steps[0]).values())
    _, _, kept, _ = plain_verdicts([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in before])
    assert rows_of(steps[1]) == {r["doc_id"]: r for r, k in zip(before, kept) if k}


def test_one_of_each_group(steps):
    before = rows_of(steps[1])
    want = plain.components([(i, r["text"]) for i, r in before.items()])
    assert rows_of(steps[2]) == {i: before[i] for (i, _), (n, c, _) in want.items() if not n or c == i}


def test_repeats_are_cut_out(steps):
    before = rows_of(steps[2])
    want = plain.shared_bytes([(i, r["text"]) for i, r in before.items()], suffix_sort.PASSAGES.size)
    after = rows_of(steps[3])
    assert set(after) == set(before)
    for (i, text), (_, gone) in want.items():
        spans = [{"start": k, "stop": k + 1} for k, g in enumerate(gone) if g]
        assert after[i]["text"] == (suffix_sort.kept_text(text, spans) if spans else text)
        assert after[i]["n_chars"] == len(after[i]["text"])


def test_leaks_go(steps, spark):
    before, after = rows_of(steps[3]), rows_of(steps[4])
    found = templates.contaminations(steps[3], spark.read.parquet(f"{SF}/benchmark.parquet"))
    leaks = {x["doc_id"] for x in found.collect()}
    assert after == {i: r for i, r in before.items() if i not in leaks}


def test_encoding(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows_of(steps[5])
    for i, r in rows_of(steps[4]).items():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert len(got) == len(rows_of(steps[4]))


def test_stages_take_odd_and_no_documents(spark, odd_docs, no_docs):
    columns = "doc_id", "text", "lang", "source", "n_chars"
    for docs, empty in ((odd_docs.select(*columns, "key"), False), (no_docs.select(*columns), True)):
        for _, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, SF), "stage")
        assert (docs.count() == 0) == empty
