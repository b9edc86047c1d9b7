import datetime as dt
import itertools
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bidscope.operators import similar

AS_OF = dt.datetime(2024, 6, 30)
NOTICE = "notice_id int, subject string, modality string, state string, estimate double, awarded double, published_at timestamp, is_open boolean, keywords array<string>"
ITEM = "item_id int, description string, code string, unit string, state string, kind string, estimate double, best_award double, platform string, created_at timestamp"


def notice(i, subject, days=0, modality="P", state="SP", keywords=(), estimate=100.0, awarded=0.0, is_open=False):
    return i, subject, modality, state, estimate, awarded, AS_OF - dt.timedelta(days=days), is_open, list(keywords)


def found(spark, rows, **options):
    known = similar.prepare_notices(spark.createDataFrame(rows, NOTICE))
    out = similar.similar_notices(known.filter("is_open"), known, F.lit(AS_OF), **options)
    return sorted(((r["ref_id"], r["notice_id"], r["tier"], r["similarity"]) for r in out.collect()))


def some_notices(seed, n=160):
    rng = random.Random(seed)
    vocabulary = ["cadeira", "mesa", "papel", "cabo", "tinta", "rede", "servico", "locacao", "licenca"]
    rows = []
    for i in range(n):
        words = rng.sample(vocabulary, rng.randint(1, 4))
        rows.append(notice(
            i, " ".join(words) if rng.random() < 0.95 else None, rng.choice([0, 1, 30, 200, 359, 400]),
            rng.choice(["P", "D", "", None]), rng.choice(["SP", "RJ", "MG", "", None]),
            rng.choice([[], words[:2], [rng.choice(vocabulary)], ["ade"], None]) or [],
            rng.choice([100.0, 0.0, None]), rng.choice([0.0, 50.0, None]), rng.random() < 0.5,
        ))
    return rows


def plain_notices(rows):
    """All pairs by the rules, on the prepared columns."""
    from bidscope.functions.fixed_values import CATEGORY_WORDS, DEFAULT_CATEGORY

    def category(text):
        held = set((text or "").split())
        return next((name for name, words in CATEGORY_WORDS.items() if held & set(words)), DEFAULT_CATEGORY)

    out = []
    for i, subject, form, state, _, _, _, is_open, keywords in rows:
        if not is_open:
            continue
        recent = [r for r in rows if (AS_OF - r[6]).days <= 360 and r[0] != i and (not form or r[2] == form)]
        hits = [r for r in recent if set(keywords) & set((r[1] or "").split())]
        near = [r for r in hits if state and r[3] == state]
        tier, chosen = (1, near) if len(near) >= 3 else (2, hits)
        if not hits and keywords:
            tier, chosen = 3, [r for r in recent if keywords[0] in (r[1] or "")]
        for r in chosen:
            if category(r[1]) == category(subject) and ((r[5] or 0) > 0 or (r[4] or 0) > 0):
                out.append((i, r[0], tier))
    return sorted(out)


def test_all_notices_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "MIN_NOTICE_SCORE", 0)
    rows = some_notices(3)
    got = [x[:3] for x in found(spark, rows)]
    assert got == plain_notices(rows)
    assert {t for *_, t in got} == {1, 2, 3}


@pytest.mark.parametrize("limit", [1, 4])
def test_a_limit_keeps_the_best_by_similarity(spark, limit):
    rows = some_notices(4)
    at = {r[0]: r[6] for r in rows}
    want, per_ref = [], {}
    for ref, i, tier, score in found(spark, rows):
        per_ref.setdefault(ref, []).append((-score, -at[i].timestamp(), i, tier))
    for ref, own in per_ref.items():
        want += [(ref, i, tier, -score) for score, _, i, tier in sorted(own)[:limit]]
    assert found(spark, rows, limit=limit) == sorted(want)


def test_an_old_match_behind_many_newer_ones_of_another_category(spark):
    rows = [notice(0, "cadeira giratoria", 0, keywords=["cadeira"], is_open=True), notice(1, "cadeira de escritorio", 350)]
    rows += [notice(2 + k, "servico de reparo de cadeira", 1) for k in range(60)]
    assert [x[:3] for x in found(spark, rows)] == [(0, 1, 1)]
    assert [x[:3] for x in found(spark, rows, limit=1)] == [(0, 1, 1)]


def test_no_notices(spark):
    assert found(spark, []) == []


def some_items(seed, n=250):
    rng = random.Random(seed)
    vocabulary = ["cadeira", "mesa", "papel", "cabo", "tinta", "rede"]
    return [
        (
            i, " ".join(rng.sample(vocabulary, rng.randint(1, 5))), rng.choice(["1234", "12", None]), rng.choice(["un", "", None]),
            rng.choice(["SP", "RJ", None]), rng.choice(["M", "S", None]), rng.choice([10.0, 0.0]), rng.choice([None, 8.0, 0.0]), "P1",
            AS_OF - dt.timedelta(days=rng.choice([0, 5, 200, 900])),
        )
        for i in range(n)
    ]


def items_found(spark, **options):
    known = similar.prepare_notices(spark.createDataFrame([r for r in some_notices(5) if r[7]], NOTICE))
    goods = similar.prepare_items(spark.createDataFrame(some_items(6), ITEM))
    out = similar.similar_items(similar.item_questions(known), goods, F.lit(AS_OF), **options)
    return {(r["profile"], r["item_id"]): (r["similarity"], r["tier"]) for r in out.collect()}


def test_items_of_all_pairs(spark):
    got, items = items_found(spark), some_items(6)
    assert {tier for _, tier in got.values()} == {1, 2, 3}
    for profile in {p for p, _ in got}:
        terms, state, kind, _ = profile.split("|")
        needed = set(terms.split()[:4])
        hits = [r for r in items if r[6] > 0 and needed <= set(r[1].split()) and kind in ("*", r[5] or "")]
        near = [r for r in hits if r[4] == state]
        chosen = near if len(near) >= 3 else hits
        own = {i for p, i in got if p == profile}
        if hits:
            assert own <= {r[0] for r in chosen}
        # what was left out has no price, another category or too little similarity
        newest = [r for r in chosen if hits and (r[7] is None or r[7] > 0) and r[5] and r[2] == "1234" and r[9] == AS_OF]
        assert {r[0] for r in newest} <= own


@pytest.mark.parametrize("limit", [1, 3])
def test_a_limit_keeps_the_best_items(spark, limit):
    at = {r[0]: r[9] for r in some_items(6)}
    per_profile = {}
    for (profile, i), (score, tier) in items_found(spark).items():
        per_profile.setdefault(profile, []).append((-score, -at[i].timestamp(), i, tier))
    want = {(p, i): (-s, t) for p, own in per_profile.items() for s, _, i, t in sorted(own)[:limit]}
    assert items_found(spark, limit=limit) == want


def test_texts_of_items_are_read_once_per_class(spark):
    known = similar.prepare_notices(spark.createDataFrame([notice(0, "trator", keywords=["trator"], is_open=True)], NOTICE))
    texts = ["trator", "TRATOR", "tr\u00e1tor ", "  trator azul", None]
    rows = [(i, t, "1234", "un", "SP", "M", 10.0, None, "P1", AS_OF) for i, t in enumerate(texts)]
    goods = similar.prepare_items(spark.createDataFrame(rows, ITEM))
    out = similar.similar_items(similar.item_questions(known), goods, F.lit(AS_OF))
    # spellings of one text count together, and four of the same state are enough for the first tier
    assert sorted((r["item_id"], r["tier"]) for r in out.collect()) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    # rows meet their class by the text as it stands: what is left to do for each row takes no words from it
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_a_notice_are_written_together(spark, tmp_path):
    """As many rows as pairs are only bearable in columns if a set's pairs stand together, notice by notice."""
    sets, own = 60, 12
    rng = random.Random(4)
    refs = [(i * 7_919_000_003, f"q{i % sets}", 1) for i in range(sets * own)]
    # a notice is in many sets, and two rows are references as well
    members = [(f"q{q}", 1, i, float(i)) for i in [refs[0][0], refs[7][0], *range(1, 14)] for q in range(sets) if rng.random() < 0.9]
    rng.shuffle(members)
    found = similar.SimilarNotices(
        spark.createDataFrame(refs, "ref_id long, question string, tier int"),
        spark.createDataFrame(members, "question string, tier int, notice_id long, value double"),
    )
    rows = found.rows()
    assert rows.columns == ["question", "tier", "ref_id", "notice_id", "value"]
    rows.write.parquet(str(tmp_path / "pairs"))
    by_set, got = {}, []
    for ref, q, _ in refs:
        by_set.setdefault(q, []).append(ref)
    for file in (tmp_path / "pairs").glob("*.parquet"):
        pairs = [(r["question"], r["notice_id"], r["ref_id"]) for r in pq.read_table(file).to_pylist()]
        got += pairs
        for runs in ([q for q, _, _ in pairs], [(q, n) for q, n, _ in pairs]):
            assert len(list(itertools.groupby(runs))) == len(set(runs))
    assert sorted(got) == sorted((m[0], m[2], ref) for m in members for ref in by_set[m[0]] if ref != m[2])
