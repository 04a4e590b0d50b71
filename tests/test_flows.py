"""Intervals, residency, subagents, comparisons."""

import random

from tesseral.operators import agents, compare, intervals


def test_merge_touching_and_gaps(spark):
    df = spark.createDataFrame([("f", 1, 10), ("f", 11, 20), ("f", 30, 40), ("f", 35, 36), ("f", 9, 5), ("g", 1, 1)], "k string, s bigint, e bigint")
    m = intervals.merge_intervals(df, ["k"], "s", "e")
    assert sorted(map(tuple, m.collect())) == [("f", 1, 20), ("f", 30, 40), ("g", 1, 1)]
    assert [tuple(r) for r in intervals.gaps(m, ["k"], "s", "e").collect()] == [("f", 21, 29)]
    p = spark.createDataFrame([("f", 20, 1), ("f", 25, 2), ("f", 50, 3), ("h", 1, 4)], "k string, at bigint, id int")
    assert sorted((r["id"], r["end_before"], r["start_after"]) for r in intervals.uncovered(p, m, ["k"], "at", "s", "e").collect()) == [(2, 20, 30), (3, 40, None), (4, None, None)]


def test_residency(spark):
    changes = [("s", "a", 1, "path_glob_match"), ("s", "b", 1, "session_start"), ("s", None, 5, None), ("s", None, 7, None), ("s", "a", 8, "path_glob_match"), ("s", None, 8, None), ("s", "c", 9, "path_glob_match")]
    probes = [("s", t, t) for t in (0, 2, 6, 8, 9)]
    got = intervals.residency(spark.createDataFrame(changes, "s string, key string, at bigint, reason string"), spark.createDataFrame(probes, "s string, at bigint, probe bigint"), "s", "key", "at")
    gone = {(r["key"], r["probe"]): r["evicted_at"] for r in got.collect() if not r["resident"]}
    assert gone == {("a", 6): 5}  # the load at 8 wins over the compaction at 8
    assert got.count() == 15


def test_markers(spark):
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate((10, 20, None, 30))], "s string, i bigint, at bigint")
    marks = spark.createDataFrame([("s", 1, 15), ("s", 2, 15), ("s", 3, 99), ("s", 4, None), ("s", 5, 12)], "s string, mark bigint, at bigint")
    out = intervals.insert_markers(rows, marks, "s", "i", "at").orderBy("place").collect()
    assert [r["i"] if r["mark"] is None else f"m{r['mark']}" for r in out] == [0, "m5", "m2", "m1", 1, 2, 3, "m3", "m4"]


def test_lanes_are_the_lowest_free(spark):
    rnd = random.Random(2)
    steps, times = [], rnd.sample(range(10_000), 120)
    for i in range(60):
        a, b = sorted(times[2 * i : 2 * i + 2])
        steps.append(("s", a, 0, f"x{i}", True))
        if i % 7:
            steps.append(("s", b, 1, f"x{i}", False))
    df = spark.createDataFrame(steps, "s string, t bigint, k int, x string, opens boolean")
    got = {r["x"]: r["lane"] for r in agents.lanes(df, "s", ["t", "k", "x"], "x", "opens").collect()}
    used, want = {}, {}
    for _, _, _, x, opens in sorted(steps, key=lambda r: r[1:4]):
        if opens:
            want[x] = used[x] = next(i for i in range(100) if i not in used.values())
        else:
            used.pop(x, None)
    assert got == want


def test_fan_outs(spark):
    rows = ["turn", "spawn a", "spawn b", "return a", "return b", "turn", "spawn c", "spawn d", "turn", "return c", "return d", "spawn e"]
    df = spark.createDataFrame([("s", i, r.split()[0], r.split()[-1]) for i, r in enumerate(rows)], "s string, i int, kind string, ref string")
    assert [tuple(r) for r in agents.fan_outs(df, "s", ["i"], "kind", "ref").collect()] == [("s", 2, 2, "a,b")]


def test_reports_by_id_then_name(spark):
    spawns = spark.createDataFrame([("s", 1, "a", "n"), ("s", 2, "b", "n"), ("s", 3, "c", "n")], "session string, at bigint, spawn string, name string")
    rep = [("s", 4, "r1", "b", "n", False), ("s", 5, "r2", None, "n", False), ("s", 6, "r3", "other", "n", True), ("s", 7, "r4", None, "n", False), ("s", 8, "r5", None, "n", False)]
    got = agents.pair_with_names(spawns, spark.createDataFrame(rep, "session string, at bigint, report string, ref string, name string, foreign boolean"))
    assert {r["report"]: (r["spawn"], r["matched_by"]) for r in got.collect()} == {"r1": ("b", "id"), "r2": ("a", "name"), "r3": (None, "unmatched"), "r4": ("c", "name"), "r5": (None, "unmatched")}


def test_alignment(spark):
    steps = [("p", "a", i, x) for i, x in enumerate("ABCDE")] + [("p", "b", i, x) for i, x in enumerate("AXCEF")]
    got = compare.align(spark.createDataFrame(steps, "pair string, side string, n int, step string"), "pair", "side", "n", "step").orderBy("place").collect()
    assert [(r["kind"], r["step_a"], r["step_b"]) for r in got] == [("match", "A", "A"), ("changed", "B", "X"), ("match", "C", "C"), ("removed", "D", None), ("match", "E", "E"), ("added", None, "F")]


def test_diff_and_folds(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert sorted((r["k"], r["change"]) for r in compare.block_diff(a, b, ["k"], "v").collect()) == [(1, "removed"), (2, "changed"), (4, "added")]
    assert {r["k"]: r["presence"] for r in compare.presence(a, b, ["k"]).collect()} == {1: "a-only", 2: "both", 3: "both", 4: "b-only"}
    s = spark.createDataFrame([("a", "used"), ("a", "ignored"), ("b", "odd"), ("b", None)], "k string, st string")
    assert {r["k"]: r["st"] for r in compare.fold_status(s, ["k"], "st", ["ignored", "used"], "none").collect()} == {"a": "ignored", "b": "none"}
    u = compare.union_first_wins([a.where("k = 2"), b], ["k"]).orderBy("k").collect()
    assert [(r["k"], r["priority"], r["v"]) for r in u] == [(2, 0, "y"), (3, 1, None), (4, 1, "w")]
