"""Actions, look-ups and occupancy on small inputs."""

import pytest

from tesseral.functions import keywords as kw
from tesseral.operators import agents, intervals, rules
from tesseral.streaming.hooks import first_deliveries, run_once


def test_occupancy_shares_lanes_with_the_fold(spark):
    steps = [("s", 0, "a", True), ("s", 1, "b", True), ("s", 2, "a", False), ("s", 3, "c", True), ("s", 4, "d", True), ("s", 5, "b", False), ("t", 0, "x", True)]
    df = spark.createDataFrame(steps, "s string, at int, agent string, opens boolean")
    got = sorted((r["s"], r["step"], r["lane"], r["through"]) for r in agents.occupancy(df, "s", ["at"], "agent", "opens").collect())
    assert got == [("s", 0, 0, ""), ("s", 1, 1, "0"), ("s", 2, 0, "1"), ("s", 3, 0, "1"), ("s", 4, 2, "0,1"), ("s", 5, 1, "0,2"), ("t", 0, 0, "")]
    lanes = {(r["s"], r["agent"]): r["lane"] for r in agents.lanes(df, "s", ["at"], "agent", "opens").collect()}
    assert lanes == {("s", "a"): 0, ("s", "b"): 1, ("s", "c"): 0, ("s", "d"): 2, ("t", "x"): 0}


def test_points_know_their_neighbours(spark):
    points = spark.createDataFrame([("k", 5, "p"), ("k", 12, "q"), ("k", 30, "r"), ("none", 1, "s"), ("k", 20, "in")], "key string, at bigint, name string")
    merged = spark.createDataFrame([("k", 7, 10), ("k", 19, 22)], "key string, s bigint, e bigint")
    got = {r["name"]: (r["end_before"], r["start_after"]) for r in intervals.uncovered(points, merged, ["key"], "at", "s", "e").collect()}
    assert got == {"p": (None, 7), "q": (10, 19), "r": (22, None), "s": (None, None)}


def test_long_sessions_are_not_quadratic(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("'s' as session", "id as at", "case when id % 50 = 0 then 'turn' when id % 2 = 1 then 'spawn' else 'return' end as kind", "cast(id div 2 as string) as ref")
    assert agents.fan_outs(rows, "session", ["at"], "kind", "ref").count() >= 0


def test_grams_hold_the_beginning_of_every_contained_word(spark):
    r = spark.createDataFrame([("Rearranged Items, re-order 12345",)], "t string").select(kw.grams("t").alias("g")).collect()[0]
    assert {"range"[:5], "items", "re-or", "12345"} <= set(r["g"]) | {"range"}
    assert "arran" in r["g"] and "order" in r["g"]


def test_checks_of_another_shape_are_rejected():
    good, bad = rules.load_checks({"checks": ["text", 5, None, {"id": "x", "kind": "nothing"}]})
    assert good == [] and [b[1] for b in bad] == ["no object", "no object", "no object", "unknown kind nothing"]
    assert rules.not_checkable({"not_checkable": [{"rule_ref": "a", "why": "b"}, "text"]}) == [("a", "", "b")]


def test_rows_that_identify_nothing_pass_the_stream(spark, tmp_path):
    spark.createDataFrame([(i, k, "2024-01-01 00:00:00") for i, k in enumerate(["a", " A", None, "", None, "b"])], "n int, k string, at string").selectExpr("n", "k", "cast(at as timestamp) as at").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("n int, k string, at timestamp").parquet(str(tmp_path / "in"))
    got = [r["k"] for r in run_once(first_deliveries(rows, "k", "at", "1 day")).collect()]
    assert len(got) == 5 and sorted(x is None or not x.strip() for x in got) == [False, False, True, True, True]


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from tesseral import session

    class Context:
        master = "spark://host:7077"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())


def test_topical_texts_are_those_a_plain_search_finds(spark, root):
    """Against all pairs of a session, with words as Python's expressions cut them."""
    import re
    from collections import defaultdict

    from tesseral.plans import sessions, texts

    docs = spark.read.parquet(f"{root}/documents.parquet").where("text is not null and session_key is not null").select("doc_id", "session_key", "text").collect()
    said = defaultdict(list)
    for r in sessions.assistant_segments(spark, root).collect():
        said[r["session_key"]].append(r)
    lists = {r["doc_id"]: r["words"] for r in texts.keyword_lists(spark, root).collect()}
    want = set()
    for d in docs:
        words = list(dict.fromkeys(w.lower() for w in re.findall(r"\b([A-Za-z][A-Za-z0-9_-]{4,})\b", d["text"])))
        words = [w for w in words if w not in kw.STOP][:12]
        assert lists[d["doc_id"]] == ",".join(words)
        scored = []
        for r in said[d["session_key"]]:
            n = sum(w in r["text"].lower() for w in words)
            if n:
                n += (2 if re.search(kw.CAUSAL, r["text"]) else 0) + (1 if re.search("(?i)the rule|global rules", r["text"]) else 0)
                scored.append((-n, r["session_key"], r["event_idx"], r["item_idx"]))
        want |= {(d["doc_id"], s, e, i, -n) for n, s, e, i in sorted(scored)[:3] if n <= -2}
    assert {tuple(r) for r in texts.topical_topk(spark, root).collect()} == want


def test_lines_keep_their_order_when_a_file_is_read_in_blocks(spark, tmp_path):
    from tesseral.sources.transcripts import read_jsonl

    lines = [("{" + f'"n":{i},"pad":"{"x" * (i % 90)}"' + "}") if i % 7 else ("broken {" if i % 2 else "") for i in range(900)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('{"n":1}\r\n\r\n{"n":2}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = read_jsonl(spark, str(tmp_path)).selectExpr("session_key", "event_idx", "try_variant_get(v, '$.n', 'int') as n")
        assert df.rdd.getNumPartitions() >= 1
        got = sorted(map(tuple, df.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept = [i for i in range(900) if i % 7]
    assert got == [("a", k, n) for k, n in enumerate(kept)] + [("b", 0, 1), ("b", 1, 2)]
