import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from bidscope.llm import piece_spans

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "ab ▁ \n\té你😀́\x00\x85\xa0.,1 2<s></s><0x41>…ﬁ  ​�"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def pieces_of(model, text):
    return [(int(i), int(b), int(e)) for part in model.encode(text) for i, b, e in zip(*part)]


def odd_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    return [*texts, "", " ", "  ", " a", "\0", "x" * 1000, "ab" * 500 + " " * 300, "é你😀" * 200, "日本語" * 300 + " the end"]


def test_ids_and_source_ranges_equal_the_librarys(library):
    model = piece_spans.model(PATH)
    for text in odd_texts():
        want = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert pieces_of(model, text) == want


def test_decoding_equals_the_librarys(library):
    model, rng = piece_spans.model(PATH), random.Random(4)
    for text in odd_texts():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert model.decode(ids).decode() == library.decode(ids)
    for _ in range(3000):  # broken characters, control and unknown ids among them
        ids = [rng.choice([rng.randrange(32000), rng.randrange(270), rng.randrange(3)]) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids).decode() == library.decode(ids)


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("tidy", [True, False])
def test_compiled_maps_take_the_longest_prefix(rule, tidy):
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=tidy
    )
    model, rng = piece_spans.Model(library.serialized_model_proto()), random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(LETTERS + "ＡＢ㌀ｶﾞ½Ⅷ　ﷺÅΩßẞ") for _ in range(rng.randint(0, 30)))
        want, at = library.normalize(text, with_offsets=True)
        got = list(model.normalise(text))
        assert "".join(own for own, _ in got) == want
        if got:
            assert got[0][1].tolist() == [len(text[:k].encode()) for k in at]


def test_long_texts_go_in_stretches(monkeypatch):
    model = piece_spans.model(PATH)
    text = "a few words,  and\nlines 12 é " * 500
    whole = pieces_of(model, text)
    monkeypatch.setattr(piece_spans, "CHUNK", 60)
    assert pieces_of(model, text) == whole and len(list(model.encode(text))) > 100


def test_round_trip_of_odd_documents(odd_docs, odd_rows, no_docs, library):
    want = []
    for i, text in odd_rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        spans = b"".join(x.to_bytes(8, "little") for p in library.encode(text or "", return_type="proto").pieces for x in (p.begin, p.end))
        digests = (hashlib.sha256(x).hexdigest() for x in (raw, library.decode(ids).encode(), spans))
        want.append((i, len(ids), *digests))
    got = [tuple(r) for r in piece_spans.round_trip(odd_docs, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert piece_spans.round_trip(no_docs, PATH).count() == 0


def test_pieces_as_a_column(odd_docs, no_docs):
    rows = piece_spans.encode(odd_docs, PATH, pieces="key").collect()
    assert sorted(rows[0].asDict()) == sorted(odd_docs.columns)
    for r in rows:
        raw = (r["text"] or "").encode()
        assert b"".join(raw[p["begin"] : p["end"]] for p in r["key"]) == raw
    assert piece_spans.encode(no_docs, PATH).count() == 0
