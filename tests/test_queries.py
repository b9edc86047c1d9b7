"""A selection of registered queries against their SQL on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entries
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# item keys made of a line's columns repeat in the smallest tables, and joins need them unique
LARGER = {"J15_similar_items": "/root/testdata/sf0.01"}
CHOSEN = [
    "D1_price_summary_after_iqr", "D5_percentiles", "J16_redundant_groups", "D14_comparability_score", "J6_notice_items",
    "J14_similar_notices", "J15_similar_items", "R3_prospect_org", "T9_find_deadlines", "C1_detect_changes",
    "D22_dashboard_summary", "S14_gazette_to_notice", "D26_session_notice_view",
]

pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")


def test_every_sql_has_its_query():
    assert set(entries.oracle_sql()) <= set(entries.queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    folder = LARGER.get(name, SF)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = entries.queries()[name](spark, folder)
    result = con.execute(entries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())
