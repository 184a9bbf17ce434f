"""The driver contract: registered names, oracles, and agreement on small data."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "team_ppp", "stints", "on_off_table", "clutch_shift", "scoring_droughts", "duo_teams",
    "rank_sum_matrix", "rolling_form", "played_vs_missed", "cells_to_rows", "json_result_sets",
    "dq_clock_dirty", "dq_duplicates_dirty", "top_n_counts", "rank_sum_holm", "season_partitions", "csv_roundtrip", "declared_schema",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert not {n for n in without if not re.match(r"op\d+_|pipeline$", n)}  # the optional text operators have tests of their own


def test_entry_runs(spark):
    table = entry.entry(spark)
    assert "total_net_rtg" in table.columns and table.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in "supplier part orders lineitem events pages customer".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    got = entry.queries()[name](spark, SF).select(*cols)
    tidy = lambda rs: sorted(str([round(float(v), 5) if isinstance(v, float) else v for v in r]) for r in rs)
    assert tidy(tuple(r) for r in got.collect()) == tidy(want)
