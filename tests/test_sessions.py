"""Turns, usage, allocation and prompts."""

import json
import random

from pyspark.sql import functions as F

from tesseral.functions.messages import notification
from tesseral.functions.variant import parse_object
from tesseral.operators import sessions
from tesseral.operators.allocate import largest_remainder, with_history
from tesseral.sources import transcripts as tr

EV = "session_key string, event_idx bigint, type string, ts string, is_meta boolean, session_id string, git_branch string, cwd string, version string, request_id string, message string, attachment string"


def events(spark, rows):
    out = [("s", i, kind, f"2026-01-01T00:00:{i:02d}.000Z", meta, None, None, None, None, None, json.dumps({"content": c}), None) for i, (kind, c, meta) in enumerate(rows)]
    return tr.events(spark.createDataFrame(out, EV))


def prompts(spark, rows):
    return [r["prompt"] for r in tr.prompts(events(spark, rows)).orderBy("event_idx").collect()]


def test_what_is_a_prompt(spark):
    text = lambda t: [{"type": "image"}, {"type": "text", "text": t}]
    rows = [
        ("user", "hello", None), ("user", "hello", True), ("user", "  ", None), ("user", text(" look "), None), ("user", [{"type": "tool_result", "tool_use_id": "x"}, {"type": "text", "text": "y"}], None),
        ("user", "<local-command-caveat>x", None), ("user", "<command-name>/run</command-name><command-args> fast </command-args>", None), ("assistant", "hello", None),
        ("user", "<command-name>/ls</command-name>", None), ("user", "<local-command-stdout>out", None), ("user", " <task-notification>x", None), ("user", "[Request interrupted by user for tool use]", None),
    ]
    assert prompts(spark, rows) == ["hello", None, None, "look", None, None, "/run fast", None, None, None, None, None]


def test_turns_with_compactions(spark):
    ev = tr.prompts(events(spark, [("system", "x", None), ("user", "one", None), ("assistant", "a", None), ("assistant", "b", None), ("user", "two", None), ("assistant", "c", None)]))
    comp = spark.createDataFrame([("s", us) for us in (1767225600_000000, 1767225602_500000, 1767225604_000000, 1767229999_000000)], "session_key string, us bigint")
    t = sessions.split_turns(ev, comp).orderBy("event_idx").collect()
    assert [r["turn_idx"] for r in t] == [0, 0, 0, 1, 2, 2]
    assert [r["turn_prompt"] for r in t] == ["one", "one", "one", "one", "two", "two"]
    assert [r["after_compaction"] for r in t] == [False, False, False, True, True, False]
    none = sessions.split_turns(ev.withColumn("prompt", F.lit(None).cast("string")), comp)
    assert [r["turn_idx"] for r in none.collect()] == [None] * 6


def test_first_at_or_after_is_by_file_order(spark):
    ev = spark.createDataFrame([("s", 0, 50), ("s", 1, 10), ("s", 2, None), ("s", 3, 30)], "s string, i bigint, at bigint")
    marks = spark.createDataFrame([("s", 20, 1), ("s", 50, 2), ("s", 51, 3), ("t", 1, 4)], "s string, at bigint, m bigint")
    assert {r["m"]: r["i"] for r in sessions.first_at_or_after(ev, marks, "s", "i", "at", "m").collect()} == {1: 0, 2: 0, 3: None, 4: None}


def test_usage_is_deduplicated_and_tolerant(spark):
    u = lambda **k: json.dumps(k)
    rows = [("s", 0, "r", u(input_tokens=5)), ("s", 1, "r", u(input_tokens=9)), ("s", 2, None, u(input_tokens=True, output_tokens=2.9)), ("s", 3, None, u(input_tokens="x", cache_creation={"ephemeral_1h_input_tokens": 4})), ("s", 4, "q", None)]
    df = spark.createDataFrame(rows, "session string, idx bigint, req string, j string").withColumn("u", parse_object(F.col("j")))
    got = [(r["idx"], r["input"], r["output"], r["cache_creation_1h"]) for r in sessions.usage_series(df, "session", "idx", "req", "u").orderBy("idx").collect()]
    assert got == [(0, 5, 0, 0), (2, 1, 2, 0), (3, 0, 0, 4)]


def test_cache_break(spark):
    rows = [("s", i, r, c) for i, (r, c) in enumerate([(0, 40000), (40000, 500), (41000, 500), (0, 42000), (42000, 300)])]
    df = spark.createDataFrame(rows, "session string, idx bigint, cache_read bigint, cache_creation bigint")
    assert [tuple(r) for r in sessions.cache_breaks(df, "session", "idx").collect()] == [("s", 3, 41000, 0, 42000)]


def allocate(spark, weights, total):
    df = spark.createDataFrame([("g", i, float(w), total) for i, w in enumerate(weights)], "g string, i int, w double, total bigint")
    return [r["share"] for r in largest_remainder(df, ["g"], ["i"], "w", "total").orderBy("i").collect()]


def test_allocation_is_exact(spark):
    assert allocate(spark, [100, 300], 1000) == [250, 750]
    assert allocate(spark, [1, 1, 1], 10) == [4, 3, 3]
    assert allocate(spark, [0, 0], 10) == [0, 0]
    assert allocate(spark, [1, 2], 0) == [0, 0]
    assert allocate(spark, [-5, 2], 10) == [0, 10]
    rnd = random.Random(1)
    for _ in range(3):
        w = [rnd.randint(0, 50) for _ in range(40)]
        assert sum(allocate(spark, w, 12345)) == 12345


def test_history_takes_its_part_or_all(spark):
    items = spark.createDataFrame([(1, 0, 100), (2, 0, 0)], "r int, i int, w bigint")
    req = spark.createDataFrame([(1, 1000, 100), (2, 900, 0), (3, 700, 5)], "r int, total bigint, h bigint")
    got = {(r["r"], r["is_history"]): r["tokens"] for r in with_history(items, req, ["r"], ["i"], "w", "total", "h").collect()}
    assert got == {(1, False): 500, (1, True): 500, (2, False): 0, (2, True): 900, (3, True): 700}


def test_notification_fields(spark):
    t = "<task-notification><task-id>t1</task-id><status>completed</status><result>a\nb</result><usage><subagent_tokens>12</subagent_tokens><tool_uses>x</tool_uses></usage>"
    n = spark.createDataFrame([(t,), ("no",)], "t string").select(notification(F.col("t")).alias("n")).collect()
    assert n[1]["n"] is None
    assert (n[0]["n"]["task_id"], n[0]["n"]["result"], n[0]["n"]["subagent_tokens"], n[0]["n"]["tool_uses"], n[0]["n"]["summary"]) == ("t1", "a\nb", 12, None, None)


def test_files(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"type":"user","message":{"content":"hi"}}\n\nbroken\r\n[1]\n{"type":"assistant"}\n')
    (tmp_path / "x.txt").write_text("no")
    got = [(r["session_key"], r["event_idx"], r["type"]) for r in tr.transcript_rows(tr.read_jsonl(spark, str(tmp_path / "one.jsonl"))).orderBy("event_idx").collect()]
    assert got == [("one", 0, "user"), ("one", 1, "assistant")]
    assert [r["stem"] for r in tr.list_files(spark, str(tmp_path)).collect()] == ["one"]
    s = tr.file_stats(spark, str(tmp_path / "one.jsonl")).collect()[0]
    assert s["lines"] == 5 and len(s["sha256"]) == 16
    assert spark.range(1).select(tr.project_folder(F.lit("/a/b.c"))).collect()[0][0] == "-a-b-c"
