"""Nested records as flat tables."""

import json
import random

from tesseral.operators.nested import MAX_PATHS, _loads, _walk, explode_objects, flat_tables, merged_schema, own_fields


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "line_id bigint, message string, node string, row string")


def brute(texts):
    out = []
    for i, t in enumerate(texts):
        if (v := _loads(t)) is not None:
            got = []
            _walk(v, "", "", got)
            out += [(i, a, b, k) for a, b, k, *_ in got]
    return sorted(out)


def found(spark, texts, **kw):
    return sorted((r["row"], r["item_path"], r["parent_path"], r["place"]) for r in explode_objects(rows(spark, texts), "line_id", "message", **kw).collect())


CASES = [
    None, "", " ", "{", "[{}]", "5", "null", '{"a":1}', '{"a":[]}', '{"a":[{}]}', '{"a":[1,{"b":{"c":[{"d":[[{"e":1},2],[3,{"f":[{}]}]]}]}},"x",null,{"b":7}]}', '  {"a":[[{"x":[{"y":1}]}]]}\n',
    '{"a.b":[{"c d":[{}]}],"q\'s":[{}]}', '{"a":{"a":[{"a":[{"a":1}]}]}}', '{"a":[{}]} trailing', '{"a":[[[{}],{}],{}]}', '{"a":[{}]}', '{"":[{"":[{}]}]}',
]


def test_against_a_plain_walk(spark):
    assert found(spark, CASES) == brute(CASES)
    assert found(spark, CASES, nodes=False) == brute(CASES)


def test_generic_walk_gives_the_same(spark):
    assert found(spark, CASES, max_paths=1) == brute(CASES)


def test_both_ways_refuse_the_same_records(spark):
    good = '{"a":[{"b":[{}]}]}'
    bad = ['{"a":[{}],"a":[{},{}]}', '{"a":[{}],"\\u0061":[{}]}', '{"a":[{"b":1,"b":2}]}', '{"a":[{"x":NaN}]}', '{"a":[{"x":-Infinity}]}', '{"z":[{"x":Infinity}]}']
    want = [(0, "a[0]", "", 0), (0, "a[0].b[0]", "a[0]", 0)]
    assert found(spark, [good, *bad]) == found(spark, [good, *bad], max_paths=1) == want
    assert {r["path"] for r in merged_schema(rows(spark, [good, *bad]), "message").collect()} == {'["a", "[]"]', '["a", "[]", "b", "[]"]'}


def test_random_trees(spark):
    rnd = random.Random(2)

    def tree(d):
        k = rnd.random()
        if d == 0 or k < 0.25:
            return rnd.choice([1, "t", None, True])
        if k < 0.6:
            return {rnd.choice("abc"): tree(d - 1) for _ in range(rnd.randint(0, 3))}
        return [tree(d - 1) for _ in range(rnd.randint(0, 3))]

    texts = [json.dumps({"r": tree(5)}) for _ in range(120)]
    assert found(spark, texts) == brute(texts)


def test_empty_and_schema(spark):
    assert found(spark, []) == []
    got = {(r["path"], r["kinds"]) for r in merged_schema(rows(spark, ['{"a":[{"b":[1]},2]}']), "message").collect()}
    assert got == {('["a", "[]"]', 3), ('["a", "[]", "b", "[]"]', 2)}


NESTED = '{"a":1,"u":{"b":{"c":true},"n":null,"s":"x"},"l":[1,"t",[2.5,{"z":1}],null,{"k":[{"m":"q"}],"w":{"y":7}}],"e":[]}'


def test_every_value_is_in_one_table_once(spark):
    got = sorted((r["table_name"], r["item_path"], r["parent_path"], r["field"], r["text"] if r["number"] is None else r["number"]) for r in own_fields(rows(spark, [NESTED, None, "[1]", "{}"]), "line_id", "message").collect())
    assert got == sorted([
        ("", "", "", "a", 1.0), ("", "", "", "u.b.c", "true"), ("", "", "", "u.s", "x"), ("l[]", "l[0]", "", "", 1.0), ("l[]", "l[1]", "", "", "t"), ("l[][]", "l[2][0]", "", "", 2.5),
        ("l[][]", "l[2][1]", "", "z", 1.0), ("l[]", "l[4]", "", "w.y", 7.0), ("l[].k[]", "l[4].k[0]", "l[4]", "m", "q"),
    ])


def test_fields_do_not_depend_on_the_way(spark):
    df = rows(spark, [*CASES, NESTED])
    a, b = (sorted(map(tuple, own_fields(df, "line_id", "message", **kw).collect()), key=str) for kw in ({}, {"max_paths": 1}))
    assert a == b and len(a) > 15


def test_flat_tables_are_typed_and_keep_links(spark):
    t = flat_tables(rows(spark, ['{"m":"x","u":{"n":2},"a":[{"b":[{"c":1},{"c":2}],"d":true}]}', '{"m":5}']), "line_id", "message")
    assert sorted(t) == ["", "a[]", "a[].b[]"]
    assert [tuple(r) for r in t[""].select("row", "m", "u__n").orderBy("row").collect()] == [(0, "x", 2.0), (1, "5", None)]
    assert [tuple(r) for r in t["a[]"].collect()] == [(0, "", "a[0]", 0, True)]
    assert [(r["parent_path"], r["place"], r["c"]) for r in t["a[].b[]"].orderBy("place").collect()] == [("a[0]", 0, 1.0), ("a[0]", 1, 2.0)]


def test_flat_tables_beyond_the_paths_of_one_plan(spark):
    keys = [f"k{i}" for i in range(MAX_PATHS + 5)]
    t = flat_tables(rows(spark, [json.dumps({k: [{"v": k}] for k in keys})]), "line_id", "message")
    assert sorted(t) == sorted(f"{k}[]" for k in keys)
    assert [tuple(r) for r in t["k7[]"].collect()] == [(0, "", "k7[0]", 0, "k7")]


def test_keys_that_hold_brackets_keep_their_table(spark):
    df = rows(spark, ['{"a[0]":[{"x":1}]}'])
    for kw in ({}, {"max_paths": 0}):
        assert [(r["kind_path"], r["item_path"]) for r in explode_objects(df, "line_id", "message", **kw).collect()] == [("a[0][]", "a[0][0]")]
