"""The driver's contract, and queries against their SQL on the smallest tables."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tesseral.plans import catalogue


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(root):
    c = duckdb.connect()
    for p in Path(root).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p3_found", "p4_found", "p5_found"} <= set(entry.queries())


@pytest.mark.parametrize("name", ["turn_usage_totals", "p1_found", "p4_found", "p5_found", "residency_asof", "timeline_markers", "fanout_groups", "near_copies", "attribute_with_history", "cached_share", "p3_found", "p5_tables", "p5_records", "agent_rows", "lane_assignment", "lane_occupancy", "spawn_return_by_name", "before_reads", "intent_before", "loaded_names", "read_coverage", "segments", "timeline_rows", "scan_transcripts", "compare_sessions", "newest_sessions", "block_ids"])
def test_against_sql(spark, root, con, name):
    df = catalogue.QUERIES[name](spark, root)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(x) for x in r) for r in df.select(*cols).collect())
    cur = con.execute(f"select {', '.join(cols)} from ({catalogue.ORACLES[name]})")
    assert got == Counter(tuple(norm(x) for x in r) for r in cur.fetchall())
