"""The query language on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from tesseral.plans.ask import FIELDS, ask, blocks_of, bound_rows, bound_text
from tesseral.plans.reports import QueryError


def lines(spark, root, address):
    return [r["line"] for r in ask(spark, root, address).orderBy("place").collect()]


@pytest.fixture(scope="module")
def sid(spark, root):
    """A session that has blocks, files and agents if there is one."""
    d = spark.read.parquet(f"{root}/documents.parquet").where("session_key is not null and text like '%# %'").select("session_key").distinct()
    c = spark.read.parquet(f"{root}/tool_call.parquet").groupBy("session_key").agg(F.count_if(F.col("name") == "Agent").alias("a"), F.count_if(F.col("name") == "Read").alias("r"))
    return c.join(d, "session_key").orderBy(F.desc("a"), F.desc("r"), "session_key").first()["session_key"]


def test_listings_lead_to_what_they_list(spark, root, sid):
    assert any(x.startswith(sid[:8]) for x in lines(spark, root, "sessions --all"))
    assert len(lines(spark, root, sid)) == len(FIELDS["session"])
    for listing, kind in (("turns", "turn"), ("blocks", "block"), ("files", "file"), ("agents", "agent")):
        got = lines(spark, root, f"{sid} {listing} --all")
        if got:
            name = got[0].split("  ")[0]
            one = lines(spark, root, f"{sid} {name}")
            assert len(one) == len(FIELDS[kind]), (listing, name)
            assert lines(spark, root, f"{sid} {name} --field {FIELDS[kind][0]}")[0] in one[0]


def test_errors_name_the_listing(spark, root, sid):
    for address, hint in (("", "sessions"), ("zzzz", "sessions"), (f"{sid} turn-99999", "turns"), (f"{sid} turn-x", "turns"), (f"{sid} agent-none", "agents"), (f"{sid} nothing-of-the-kind", "files"), (f"{sid} --field nonsense", "valid fields"), (f"{sid} a b", "too many"), (f"{sid} --field", "needs a name")):
        with pytest.raises(QueryError, match=hint):
            ask(spark, root, address)


def test_bounds(spark):
    df = spark.range(70).selectExpr("id as place", "concat('r', id) as line")
    got = sorted(map(tuple, bound_rows(df, "x --all", False).collect()))
    assert len(got) == 61 and got[-1] == (60, "… 10 more rows, full listing: x --all")
    assert bound_rows(df, "x", True).count() == 70 and bound_rows(df.limit(60), "x", False).count() == 60
    t = spark.createDataFrame([("a" * 10,), ("b" * 3,), (None,)], "t string").select(bound_text(F.col("t"), "y", 5).alias("t")).collect()
    assert [r["t"] for r in t] == ["aaaaa … [5 more chars, full value: y]", "bbb", None]


def test_block_ids_are_those_of_the_query(spark, root, sid):
    from tesseral.plans.texts import block_ids

    ids = {r["id"] for r in block_ids(spark, root).collect()}
    assert {r["id"] for r in blocks_of(spark, root, sid).collect()} <= ids
