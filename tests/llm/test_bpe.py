import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from bidscope.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(codec, text):
    return [i for part in codec.encode(text) for i in part]


def test_ids_equal_the_librarys():
    library, codec = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    rng = random.Random(3)
    letters = "ab é'sßtRll \n\t   12९ \x1c\x85,.!😀中 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "the" * 400, "xq" * 900 + " end", "😀" * 200, "  \n" * 300]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = ids_of(codec, text)
        assert got == want
        assert codec.decode(got).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_long_texts_go_in_stretches(monkeypatch):
    codec = bpe.Codec(PATH)
    text = "a few words,  and\nlines 12 " * 500
    whole = ids_of(codec, text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 7)
    assert ids_of(codec, text) == whole and len(list(codec.encode(text))) > 100


def test_round_trip_of_odd_documents(odd_docs, odd_rows, no_docs):
    library = Tokenizer.from_file(PATH)
    want = []
    for i, text in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False).encode()
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip(odd_docs, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.round_trip(no_docs, PATH).count() == 0


def test_columns_of_ids_and_texts(odd_docs):
    there = bpe.decode(bpe.encode(odd_docs, PATH, ids="key"), PATH, ids="key", text="spans")
    assert sorted(there.columns) == sorted(odd_docs.columns)
    assert all(r["spans"] == (r["text"] or "") for r in there.collect())
