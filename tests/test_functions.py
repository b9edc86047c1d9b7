import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidscope.functions import keys, parsing, scores, text, units


def lit(value):
    return F.lit(value)


def test_normalisation_folds_accents_and_compatibility_characters(one):
    assert one(text.normalize_text(lit("Solução TÉCNICA m²"))) == "solucao tecnica m2"
    assert one(text.normalize_description(lit("  a  \n b "))) == "a b"
    assert text.normalized("Ação ½") == one(text.normalize_text(lit("Ação ½")))


def test_terms_are_filtered_mapped_once_sorted(one):
    got = one(text.extract_terms(lit("Aquisição de notebook PORTÁTIL 123 a4 e impressoras")))
    assert got == ["a4", "computador", "impressora", "notebook"]
    assert one(text.lexical_key(text.extract_terms(lit("d c b a e aa bb cc dd ee")))) == "aa bb cc dd"


@pytest.mark.parametrize(
    "a, b, expected",
    [("UN", "un", True), ("kg", "quilograma", True), ("kg", "litro", False), ("", "un", True), ("xyz", "un", False)],
)
def test_units_compatible(one, a, b, expected):
    assert one(units.units_compatible(lit(a), lit(b))) is expected


def test_canonical_units(one):
    assert one(units.canonical_unit(lit("un"))) == "pc"
    assert one(units.canonical_unit(lit("Kg"))) == "kg"
    assert one(units.canonical_unit(lit("M²"))) == "m2"


def test_categories(one):
    assert one(text.item_category(lit("servico de software"))) == "servico"
    assert one(text.item_category(lit("cadeira"))) == "produto"
    assert one(text.material_or_service(lit("software mesa"))) is None


def test_group_keys(one):
    terms = text.extract_terms(lit("gasolina comum posto cidade"))
    assert one(keys.group_keys(lit(None).cast("string"), terms, lit("l"))) == ["desc:cidade comum gasolina posto:l"]
    assert one(keys.group_keys(lit(None).cast("string"), text.extract_terms(lit("de")), lit("un"))) == []
    assert len(one(keys.group_keys(lit("8471"), terms, lit("l")))) == 3


def test_natural_key_and_hash(one):
    null = lit(None)
    assert one(keys.natural_key(lit("12345678000100"), lit(2026), lit(42))) == "12345678000100_2026_42"
    assert one(keys.natural_key(null, null, null)) == "__"
    assert len(one(keys.notice_hash(lit("PNCP"), lit("1"), lit(2026), lit(1)))) == 32
    long_a, long_b = "x" * 100 + "a", "x" * 100 + "b"
    first, second = (keys.notice_text_hash(lit("S"), lit("m"), lit(s), lit("2026-01-01T10")) for s in (long_a, long_b))
    assert one(first) == one(second)


def test_select_price(one):
    awards = F.array(lit(100.0), lit(50.0))
    assert tuple(one(scores.select_price(awards, lit(200.0)))) == (50.0, "awarded", 75.0)
    assert tuple(one(scores.select_price(F.array(lit(0.0)), lit(100.0)))) == (100.0, "estimated", None)


@pytest.mark.parametrize("score, band", [(65.0, "ALTA"), (35.0, "MEDIA"), (34.9, "BAIXA")])
def test_score_band(one, score, band):
    assert one(scores.score_band(lit(score))) == band


def test_urgency_and_closing(one):
    now = lit("2026-01-10 12:00:00").cast("timestamp")
    end = lambda t: parsing.parse_timestamp(lit(t))
    assert one(scores.urgency(end("2026-01-14 11:00:00"), now)) == "URGENTE"
    assert one(scores.urgency(end("2026-01-17 12:00:00"), now)) == "PROXIMA"
    assert one(scores.urgency(end("2026-01-09 12:00:00"), now)) == "URGENTE"
    assert one(scores.urgency(end("invalido"), now)) == "NORMAL"
    assert one(parsing.proposal_closed(end("2026-01-09T12:00:00"), now)) is True
    assert one(parsing.proposal_closed(end("invalido"), now)) is False


@pytest.mark.parametrize("shown, iso", [("15/04/2026", "2026-04-15"), ("15/04/26", "2026-04-15"), ("32/13/2026", ""), ("x", ""), ("1/1/1", "")])
def test_br_date(one, shown, iso):
    assert one(parsing.parse_br_date(lit(shown))) == iso


@pytest.mark.parametrize("shown, amount", [("R$ 500,00", 500.0), ("R$ 1.234,56", 1234.56), ("abc", 0.0)])
def test_br_money(one, shown, amount):
    assert one(parsing.parse_br_money(lit(shown))) == amount


def test_fpm_round_trip(one):
    assert one(parsing.fpm_coefficient(lit(10188))) == 0.6
    assert one(parsing.fpm_coefficient(lit(10189))) == 0.8
    assert one(parsing.population_limit(lit(2.8))) == 91692
    assert one(parsing.fpm_coefficient(lit(10**7))) == 4.0


def test_date_windows(one):
    windows = one(parsing.date_windows(lit(dt.date(2026, 1, 1)), lit(dt.date(2026, 1, 10)), 4))
    assert [(w["first"].day, w["last"].day) for w in windows] == [(1, 4), (5, 8), (9, 10)]


def test_comparable_pair_names_the_first_failed_rule(one):
    def item(source="awarded", category="produto", unit="un", value=10.0):
        return F.struct(lit(source).alias("price_source"), lit(category).alias("category"), lit(unit).alias("unit"), lit(value).alias("value"))

    reason = lambda a, b: one(units.comparable_pair(a, b))["reason"]
    assert reason(item(), item("estimated", "servico")) == "fontes_diferentes"
    assert reason(item(), item(category="servico", unit="kg")) == "categorias_incompativeis"
    assert reason(item(), item(unit="kg", value=1e6)) == "unidades_incompativeis"
    assert reason(item(), item(value=201.0)) == "escala_incompativel"
    assert reason(item(), item(value=200.0)) is None
    assert one(units.comparable_pair(item(), item(category="consumivel")))["adjust"] == 0.8


def test_reliability_bands(one):
    few = one(scores.reliability(lit(2), lit(5.0), lit(1.0), lit(10.0), lit(90.0)))
    assert few["band"] == "insuficiente"
    best = one(scores.reliability(lit(10), lit(5.0), lit(1.0), lit(10.0), lit(90.0)))
    assert (best["score"], best["band"]) == (100.0, "alta")
    no_cv = one(scores.reliability(lit(10), lit(None).cast("double"), lit(0.0), lit(400.0), lit(0.0)))
    assert no_cv["dispersion"] == 0.0 and no_cv["awarded"] == 4.0


def test_trigram_similarity(one):
    got = one(text.trigram_similarity(text.trigrams(lit("word")), text.trigrams(lit("two words"))))
    assert got == pytest.approx(4 / 11)


def test_characters_that_unfold_into_several_are_found_by_ranges(spark):
    longer = text._folding()[2]
    points = spark.range(0x10000).filter("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert {r["c"] for r in points.filter(F.rlike("c", F.lit(text._has_longer()))).collect()} == set(longer)
    assert len(text._has_longer()) < len(longer) * 12  # neighbours share a range
