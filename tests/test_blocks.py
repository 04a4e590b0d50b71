"""Running values in blocks against the plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesseral.operators import blocks, sessions


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(9)
    out = [("hot", i, rnd.choice([None, 1, 2, 5])) for i in rnd.sample(range(40_000), 6000)] + [(f"s{k}", i, 1) for k in range(20) for i in range(rnd.randint(0, 9))] + [(None, 3, 1), (None, 4, 2)]
    return spark.createDataFrame(out, "k string, i bigint, v int").cache()


@pytest.mark.parametrize("own", [True, False])
def test_sums_are_those_of_one_window(rows, own):
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    want = rows.select("k", "i", F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(w), F.lit(0)).alias("s"))
    got = blocks.running_sum(rows, ["k"], ["i"], F.col("v"), "s", own=own).select("k", "i", "s")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_numbers_are_those_of_one_window(rows):
    want = rows.select("k", "i", (F.row_number().over(Window.partitionBy("k").orderBy("i")) - 1).cast("bigint").alias("n"))
    assert sorted(map(str, blocks.numbered(rows, ["k"], ["i"], "n").select("k", "i", "n").collect())) == sorted(map(str, want.collect()))


def test_empty(spark):
    assert blocks.numbered(spark.createDataFrame([], "k string, i bigint"), ["k"], ["i"], "n").collect() == []


def test_turns_do_not_depend_on_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    ev = spark.createDataFrame([(s, i, i * 1000 + rnd.randint(-3000, 3000) if rnd.random() < 0.9 else None, f"p{i}" if rnd.random() < 0.2 else None) for s in "abc" for i in sorted(rnd.sample(range(300), 120))], "session_key string, event_idx bigint, us bigint, prompt string")
    marks = spark.createDataFrame([(s, rnd.randint(0, 300_000)) for s in "abc" for _ in range(4)], "session_key string, us bigint")
    run = lambda: sorted(map(tuple, sessions.split_turns(ev, marks).select("session_key", "event_idx", "turn_idx", "turn_prompt", "after_compaction").collect()))
    whole = run()
    for size in (1, 7, 50):
        monkeypatch.setattr(sessions, "block_of", lambda c, n=0, size=size: F.floor((F.col(c) if isinstance(c, str) else c) / (size * 1000 if n else size)).cast("bigint"))
        monkeypatch.setattr(blocks, "block_of", lambda c, n=0, size=size: F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("bigint"))
        assert run() == whole
    assert any(r[4] for r in whole) and len({r[2] for r in whole}) > 10
