"""Some query rows of each module against their oracle SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
NAMES = (
    "parsed_terminal parsed_patch admission session_events vocabulary_leaks compress_patch phase_transitions rendered_chain request_bodies"
    " record_scan chain_scan_first result_scan chain_sink score_report_v0 score_report_v2 pair_sides power_cells carrier_types stream_sessions"
).split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "events documents labels conversations orders customer".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_row(spark, oracle, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = oracle.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert got == want
