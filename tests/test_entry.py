import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["q_lines_ids", "q_merge_capped", "q_kfold", "q_bucket_batches", "q_speaker_first_overlap", "q_normalize_rules", "q_hypotheses", "q_wer_by_file", "q_arpa"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted(map(repr, result.fetchall()))
    got = sorted(repr(tuple(r)) for r in entry.queries()[name](spark, SF).select(*columns).collect())
    assert got == want
