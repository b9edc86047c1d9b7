from bidscope.plans import session
from bidscope.plans.pricing import best_awards


def test_shared_items_feed_both_views(spark):
    rows = spark.createDataFrame(
        [
            ("1-1", 1, False, "P1", "papel branco", "1234", "un", 10.0, "SP", "X", "a", "ALTA", 5),
            ("1-2", 1, False, "P2", "papel branco", "1234", "un", 20.0, "SP", "X", "a", "ALTA", 6),
            ("2-1", 2, True, None, None, None, None, 0.0, None, None, None, None, 7),
        ],
        "item_id string, notice_id int, excluded boolean, platform string, description string, code string, unit string, "
        "estimate double, state string, municipality string, subject string, relevance string, other int",
    )
    awards = spark.createDataFrame([("1-1", 8.0)], "item_id string, unit_award double")
    best = awards.withColumnRenamed("unit_award", "best_award")
    shared = session.shared_items(rows)
    # both views read the staged rows, not the joins behind them
    assert len(shared.inputFiles()) > 0 and shared.count() == 3

    def views(of):
        items = session.session_item_view(of.filter("NOT excluded").join(best, "item_id", "left"))
        return sorted(map(str, items.collect())), sorted(map(str, session.session_notice_view(of, awards).collect()))

    assert views(shared) == views(rows) and len(views(rows)[0]) > 0


def test_shared_items_with_awards_need_no_further_lookup(spark):
    rows = spark.createDataFrame(
        [
            ("1-1", 1, False, "P1", "papel branco", "1234", "un", 10.0, "SP", "X", "a", "ALTA"),
            ("1-2", 1, False, "P2", "papel branco", "1234", "un", 20.0, "SP", "X", "a", "ALTA"),
            ("2-1", 2, True, "P2", "papel branco", "1234", "un", 30.0, None, None, None, None),
        ],
        "item_id string, notice_id int, excluded boolean, platform string, description string, code string, unit string, "
        "estimate double, state string, municipality string, subject string, relevance string",
    )
    awards = spark.createDataFrame([("1-1", 8.0, 1), ("1-1", 6.0, 2), ("2-1", -1.0, 1)], "item_id string, unit_award double, award_seq int")
    best = best_awards(awards)
    shared = session.shared_items(rows, best)
    plain = rows.join(best.select("item_id", "best_award"), "item_id", "left")
    want = [session.session_item_view(plain.filter("NOT excluded")), session.session_notice_view(rows, awards)]
    views = [session.session_item_view(shared.filter("NOT excluded")), session.session_notice_view(shared)]
    for got, of in zip(views, want):
        assert sorted(map(str, got.collect())) == sorted(map(str, of.collect())) != []
    # the awards were joined ahead of the staged rows, once for both
    assert "Join" not in views[1]._jdf.queryExecution().optimizedPlan().toString()
    # of rows without texts the summary is the same
    few = session.shared_items(rows, best, described=False)
    assert not {"subject", "municipality", "state", "relevance", "item_id"} & set(few.columns)
    counted = session.session_summary(session.session_item_view(few.filter("NOT excluded")), session.session_notice_view(few))
    assert counted.collect() == session.session_summary(*want).collect()
