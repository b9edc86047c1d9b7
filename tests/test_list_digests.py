import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bidscope.operators.list_digests import list_digests
from bidscope.plans import dossier, pricing
from tests.test_similar import AS_OF, ITEM, NOTICE, some_notices

INF, NAN = float("inf"), float("nan")


def above(v):
    """The engine's order: a NaN is above any number."""
    return (v != v, 0.0 if v != v else v)


@pytest.mark.parametrize("limit", [None, 1, 3])
def test_digests_of_narrowed_lists(spark, limit):
    rng = random.Random(8)
    lists = [(f"k{k}", i, rng.choice([0.0, 1.0, 5.0, 5.5, 9.0, NAN]), f"é{i}" * rng.randint(0, 3), rng.choice([1, 2])) for k in range(7) for i in range(k * 5)]
    lists.append(("k3", None, 5.0, "no id", 1))
    refs = [(f"k{rng.randint(0, 8)}", i, rng.choice([-INF, 0.5, 5.0, 7.0, NAN]), rng.choice([INF, 5.0, 0.5, NAN])) for i in range(60)]
    out = list_digests(
        spark.createDataFrame(lists, "key string, id long, value double, text string, place int").repartition(5),
        spark.createDataFrame(refs, "key string, ref long, low double, high double"),
        ["key"], "ref", "id", [F.col("place"), F.col("id")], "digest", limit,
    )
    want = {}
    for key, ref, low, high in refs:
        own = sorted((r for r in lists if r[0] == key and r[1] is not None), key=lambda r: (r[4], r[1]))
        if own:
            kept = [r[3] for r in own if r[1] != ref and above(low) <= above(r[2]) <= above(high)][:limit]
            want[ref] = hashlib.md5(" ".join(kept).encode()).hexdigest()
    assert want and {r["ref"]: r["digest"] for r in out.collect()} == want


def test_digests_are_those_of_the_lists_but_no_list_is_copied(spark):
    rng = random.Random(4)
    rows = [(r[0] + 1000 * k, *r[1:5], rng.choice([None, 0.0, 3.0, 100.0, 900.0]), *r[6:]) for r in some_notices(11) for k in range(2)]
    items = [(i, "cadeira mesa", "1234", "un", "SP", None, 80.0, None, "P1", AS_OF) for i in range(5)]
    found = pricing.reference_prices(spark.createDataFrame(rows, NOTICE), spark.createDataFrame(items, ITEM), F.lit(AS_OF))
    for limit in (None, 2):
        detail = dossier.reference_price_detail(found, max_notices=limit, notice_text=F.concat_ws(":", "notice_id", "value"))
        plain = detail.rows(notices=lambda rows: F.md5(F.array_join(F.transform(rows, lambda x: x["text"]), " ")))
        quick = detail.rows(notices=detail.notice_digests())
        want = {r["ref_id"]: r["notices"] for r in plain.collect()}
        assert {r["ref_id"]: r["notices"] for r in quick.collect()} == want and len(set(want.values())) > 2
    # a list's rows go to their references one by one, not as arrays
    assert "collect_list" not in detail.notice_digests()._jdf.queryExecution().optimizedPlan().toString()
