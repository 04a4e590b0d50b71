"""Schemas that drift between files."""

import datetime as dt
import json

from tesseral.operators.drift import promoted, schema_changes, union_table

LINE = "line_id bigint, file_id bigint, line_no int, line string, stream string"
FILE = "file_id bigint, stream string, opened_at timestamp, outer string"


def tables(spark, files):
    rows, reg, n = [], [], 0
    for i, (stream, hour, lines) in enumerate(files):
        reg.append((i, stream, None if hour is None else dt.datetime(2024, 1, 1, hour), "clash"))
        for k, x in enumerate(lines):
            rows.append((n := n + 1, i, k, x if x is None or isinstance(x, str) else json.dumps(x), "clash"))
    return spark.createDataFrame(rows, LINE), spark.createDataFrame(reg, FILE)


def changes(spark, files):
    return sorted((r["file_id"], r["change"], r["old_path"], r["new_path"]) for r in schema_changes(*tables(spark, files)).collect())


def test_rename_retype_and_nested(spark):
    files = [
        ("s", 1, [{"a": 1, "m": {"x": 1, "y": "t"}, "n": None}, "{broken", "", None]),
        ("s", 2, ["nothing here", "[1]"]),  # passed over
        ("s", 3, [{"a": "1", "msg": {"x": True, "z": "t"}, "n": {"q": 1}}]),
        ("other", 2, [{"b": 1}]),
    ]
    # m and n vanish or appear: two appear, so nothing is renamed
    assert changes(spark, files) == [(2, "added", "", "msg"), (2, "added", "", "n"), (2, "removed", "m", ""), (2, "retyped", "a", "a")]


def test_files_without_values_are_in_use(spark):
    for empty in ([{}, "broken"], [{"a": None}], [{"m": None}, {}]):
        files = [("s", 1, [{"a": 1, "m": {"x": 1}}]), ("s", 2, empty), ("s", 3, [{"a": "1"}]), ("s", 4, ["broken"]), ("s", 5, [{}])]
        assert changes(spark, files) == [(1, "removed", "a", ""), (1, "removed", "m", ""), (2, "added", "", "a"), (4, "removed", "a", "")]
    # the inner fields of an object without values are no reason to pass its file over either
    assert changes(spark, [("s", 1, [{"m": {"x": 1}}]), ("s", 2, [{"m": {}}]), ("s", 3, [{"m": {"x": 1}}])]) == [(1, "removed", "m.x", ""), (2, "added", "", "m.x")]
    lines, reg = tables(spark, [("s", 1, [{}]), ("s", 2, [{"a": 1}])])
    assert [(r["line_id"], r["a"]) for r in union_table(lines, reg).orderBy("line_id").collect()] == [(1, None), (2, 1)]


def test_renamed_parent_is_the_same_parent(spark):
    files = [("s", 1, [{"m": {"x": 1, "y": "t"}}]), ("s", 2, [{"msg": {"x": True, "z": "t"}}])]
    assert changes(spark, files) == [(1, "renamed", "m", "msg"), (1, "renamed", "m.y", "msg.z"), (1, "retyped", "m.x", "msg.x")]


def test_order_ties_null_times_and_dots(spark):
    files = [(None, None, [{"a.b": 1}]), (None, 5, [{"a.b": 1, "c": 2}]), ("s", 5, [{"c": 2.5}]), ("s", 5, [{"c": 2}])]
    # the null stream is one stream: hour 5 first, the null time after it
    assert changes(spark, files) == [(0, "removed", "c", "")]


def test_empty(spark):
    assert changes(spark, [("s", 1, []), ("s", 2, [""])]) == []
    lines, files = tables(spark, [("s", 1, [""])])
    assert union_table(lines, files).columns == ["line_id", "file_id", "line_no", "more_fields"]


def test_union_table_promotes_and_joins_renames(spark):
    files = [("s", 1, [{"old": "u", "n": 1, "o": {"p": 1}, "mix": [1]}]), ("s", 2, [{"new": "v", "n": 1.5, "o": {"p": 2}, "mix": "t"}])]
    out = union_table(*tables(spark, files)).orderBy("line_id").collect()
    assert [r["new"] for r in out] == ["u", "v"]
    assert [r["n"] for r in out] == [1.0, 1.5]
    assert [r["o__p"] for r in out] == [1, 2]
    assert [r["mix"] for r in out] == ["[1]", '"t"']
    small = union_table(*tables(spark, files), max_columns=1).orderBy("line_id").collect()
    assert {k for r in small for k in (r["more_fields"] or {})} == {"n", "new", "old", "o.p"}


def test_promotion():
    assert [promoted(k) for k in (1, 2, 3, 8, 4, 32, 5)] == ["bigint", "double", "double", "boolean", "string", "string", "string"]
