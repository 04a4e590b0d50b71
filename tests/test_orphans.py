"""References to records that do not exist."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tesseral.operators import orphans
from tesseral.operators.orphans import against_runs, contiguous_runs, find_orphans, key_codes, references

T0 = dt.datetime(2024, 1, 1)
REF = "ref_row bigint, key string, arrived_at timestamp, source_table string"
PAR = "id string, arrived_at timestamp, deleted_at timestamp, key string"


def t(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def run(spark, refs, parents):
    r = spark.createDataFrame([(i, k, t(h), "clash") for i, (k, h) in enumerate(refs)], REF)
    p = spark.createDataFrame([(k, t(a), t(d), "clash") for k, a, d in parents], PAR)
    got = find_orphans(references(r, "r", "ref_row", "key", "arrived_at"), p)
    return sorted((x["row_id"], x["reason"]) for x in got.collect())


def expected(refs, parents):
    out = []
    for i, (k, h) in enumerate(refs):
        if k is None or not k.strip():
            continue
        at = 10**9 if h is None else h
        mine = [(-(10**9) if a is None else a, 10**9 + 1 if d is None else d) for x, a, d in parents if x == k]
        if any(a <= at < d for a, d in mine):
            continue
        out.append((i, "missing" if not mine else "late" if all(a > at for a, _ in mine) else "deleted"))
    return sorted(out)


def test_each_reason_and_nulls(spark):
    parents = [("a", 1, None), ("b", 5, None), ("c", 1, 3), ("c", 6, 8), (None, 1, None), ("n", None, None), ("a", 1, None)]
    refs = [("a", 1), ("a", 1), ("b", 4), ("c", 2), ("c", 3), ("c", 7), ("c", 9), ("x", 1), (None, 1), (" \t", 1), ("n", 0), ("a", None), ("c", None), (" a", 2)]
    assert run(spark, refs, parents) == expected(refs, parents)


def test_empty_tables(spark):
    assert run(spark, [], [("a", 1, None)]) == []
    assert run(spark, [("a", 1), ("b", 1)], []) == [(0, "missing"), (1, "missing")]


def test_random_with_a_hot_key(spark):
    rnd = random.Random(3)
    keys = ["hot"] * 40 + [f"k{i}" for i in range(60)]
    parents = [(rnd.choice(keys[:80]), a := rnd.randint(0, 50), rnd.choice([None, a + rnd.randint(0, 30)])) for _ in range(150)]
    parents = [p for p in parents if p[0] != "hot" or p[2] is not None]
    refs = [(rnd.choice(keys), rnd.randint(0, 60)) for _ in range(600)]
    assert run(spark, refs, parents) == expected(refs, parents)


def test_runs_are_maximal_and_found(spark):
    keys = spark.createDataFrame([(f"k{i:04d}", i % 50 != 7) for i in range(500)], "key string, there boolean")
    coded = key_codes(keys, 3).withColumn("span", F.struct("key"))
    parents = coded.where("there").select("block", "code", "span")
    runs = contiguous_runs(parents)
    gone = {r["key"] for r in against_runs(coded.select("block", "code", "key"), runs, parents).collect() if r["run_end"] is None or r["code"] > r["run_end"]}
    assert gone == {f"k{i:04d}" for i in range(500) if i % 50 == 7}
    assert runs.count() <= 10 + 3


def test_runs_decide(spark, monkeypatch):
    """With runs that lose their last key, or that reach over gaps, other rows come out."""
    refs, parents = [(k, 2) for k in "abcdef"], [("a", 1, None), ("b", 1, None), ("d", 1, None), ("f", 1, 3)]
    right = run(spark, refs, parents)
    assert right == [(2, "missing"), (4, "missing")]
    real = orphans.contiguous_runs
    monkeypatch.setattr(orphans, "contiguous_runs", lambda c: real(c).withColumn("run_end", F.col("run_end") - 1))
    assert run(spark, refs, parents) != right
    monkeypatch.setattr(orphans, "contiguous_runs", lambda c: real(c).withColumn("run_end", F.lit(1 << 30)))
    assert run(spark, refs, parents) == []
