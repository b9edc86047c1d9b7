import random

import pytest

LETTERS = ["ab", "cé", "Dd", "e", "f.", "gg", "h%", "ii", "j", "kk"]


def sentence(rng, n, vocabulary=LETTERS):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus(seed=5):
    """(doc_id, text) with copies, near copies, shared passages, repetitions, nulls, and odd ids."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["É", "ü", "日本"]
    passage = sentence(rng, 45, words)
    rows = [(i, sentence(rng, rng.randint(1, 160), words)) for i in range(60)]
    for i in range(60, 90):
        base = rows[rng.randrange(60)][1].split(" ")
        base[rng.randrange(len(base))] = "edited"
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(base)))
    rows += [(i, f"{sentence(rng, rng.randint(0, 60), words)} {passage} {sentence(rng, rng.randint(0, 60), words)}") for i in range(90, 120)]
    rows += [(i, rows[i % 7][1]) for i in range(120, 135)]
    rows += [(135, "same " * 90), (136, "same " * 40 + "other"), (137, "ab ab cd " * 30), (138, "x" * 3000), (139, "x" * 900)]
    rows += [(140, None), (141, ""), (142, " \n\t "), (143, "A"), (144, "a"), (145, "É É É É"), (146, " ".join(words) * 30)]
    rows += [(None, rows[3][1]), (None, "nobody knows the number of this text"), (7, "another text of the same number"), rows[8], rows[8]]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return corpus()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The corpus as documents, with columns whose names clash with those that operators use inside."""
    rows = [(i, t, ["en", "de", None][k % 3], f"s{k % 2}" if k % 5 else None, len(t or ""), k, "x", k) for k, (i, t) in enumerate(odd_rows)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, spans string, `_rest` int"
    return spark.createDataFrame(rows, names).repartition(5)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
