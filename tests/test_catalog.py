import os
import sys

import pytest

from uipatterns.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SAMPLE = ["x01_explode_nodes", "x15_collapse_nested", "f12_propose_groups", "r12_run_rules", "m09_decide", "d15_drop_cross_part", "e03_average_precision",
          "g02_stratified_sample", "t03_trace_index", "w02_cadence", "page_report_listings", "page_scan_findings"]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"m07_baseline", "page_report"}


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    import pathlib

    import duckdb

    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))
    from check_oracles import norm

    con = duckdb.connect()
    for f in pathlib.Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    theirs = sorted((tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert mine and mine == theirs


@needs_data
def test_entry(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.columns == ["page_id", "url", "candidates", "findings", "page_score", "band"] and df.count() == 50
