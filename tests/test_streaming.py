"""Streams."""

import json

from tesseral.streaming import hooks


def collect(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_hook_log_windows_and_sessions(spark, tmp_path):
    rec = lambda m, e, s="s": json.dumps({"ts": f"2024-01-01T00:{m:02d}:00Z", "event": e, "session_id": s})
    (tmp_path / "a.jsonl").write_text("\n".join([rec(0, "Start"), rec(1, "Use"), rec(2, "Use"), "broken", rec(50, "Use"), json.dumps({"event": "no time"})]))
    r = hooks.read_hook_lines(spark, str(tmp_path))
    got = {(x["start"].minute, x["event"]): x["records"] for x in collect(spark, hooks.activity(r), "act", "complete")}
    assert got == {(0, "Start"): 1, (0, "Use"): 2, (50, "Use"): 1}
    assert sorted(x["records"] for x in collect(spark, hooks.sessions(r), "ses", "complete")) == [1, 3]


def test_first_deliveries(spark, tmp_path):
    rows = [("A", "2024-01-01 00:00:00"), (" a ", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:30:00"), (None, "2024-01-01 00:30:00"), (None, "2024-01-01 00:31:00"), ("", "2024-01-01 00:31:00")]
    df = spark.createDataFrame(rows, "id string, t string").selectExpr("id", "cast(t as timestamp) at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = hooks.run_once(hooks.first_deliveries(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "id", "at"))
    assert sorted((r["id"] or "").strip().lower() for r in out.collect()) == ["", "", "", "a", "b"]
