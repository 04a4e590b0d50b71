"""Deeply nested records as related flat tables.

One pass infers the merged schema of a JSON column: the paths at which arrays hold objects. The
schema then drives one chain of explodes, a level of arrays each. A row of a level hands itself
on and adds its children with the path of the parent and their place in the array, so the source
is read once, nothing is shuffled and a row's tree never leaves its task.

Defined cases
- text that is not one complete JSON object (null, broken, an array, a scalar) has no children;
- elements that are no objects (text, numbers, null) are no rows, but count in the positions;
- repeated rows and ties count each for itself; the record id is carried, not compared;
- an object repeating a key is no record (VARIANT has none), as is one with NaN or Infinity;
- empty table: no rows; other columns are ignored, so their names cannot clash.

Size: the schema is metadata, one entry a distinct array path. Beyond MAX_PATHS of them (keys
that are data) the explode is done by a generic walk instead, with the same result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.functions.variant import ARRAY, BOOLEAN, NUMBER, OBJECT, STRING, is_object, kind_bit, parse_object, path_of

MAX_PATHS = 400
ITEM = "[]"


def _shape(value: object, path: tuple[str, ...], out: dict[tuple[str, ...], int]) -> None:
    """Notes for each array path whether its elements are objects (1), others (2) or both (3)."""
    if isinstance(value, dict):
        for k, x in value.items():
            if isinstance(x, (dict, list)):
                _shape(x, (*path, k if k != ITEM else "\0[]"), out)
    else:
        p = (*path, ITEM)
        for x in value:
            if isinstance(x, dict):
                out[p] = out.get(p, 0) | 1
                _shape(x, p, out)
            else:
                out[p] = out.get(p, 0) | 2
                if isinstance(x, list):
                    _shape(x, p, out)


def _unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    if len(out := dict(pairs)) < len(pairs):
        raise ValueError("repeated key")
    return out


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def _loads(text: str | None) -> dict | None:
    """The text's object under VARIANT's rules: no repeated key, no NaN or Infinity."""
    try:
        v = json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse) if text else None
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[tuple[str, ...], int] = {}
    for b in batches:
        for t in b.column(0).to_pylist():
            if (v := _loads(t)) is not None:
                _shape(v, (), out)
    yield pa.RecordBatch.from_pydict({"path": [json.dumps(p) for p in out], "kinds": list(out.values())}, schema=pa.schema([("path", pa.string()), ("kinds", pa.int32())]))


def merged_schema(df: DataFrame, column: str) -> DataFrame:
    """(path, kinds): each array path of the column as a JSON list of keys and ``[]``, over all rows."""
    parts = df.select(F.col(column).cast("string")).where(F.col(column).contains("[")).mapInArrow(_infer, "path string, kinds int")
    return parts.groupBy("path").agg(F.bit_or("kinds").alias("kinds"))


def _walk(value: object, path: str, parent: str, out: list[tuple[str, str, int, str, str]], table: str = "") -> None:
    if isinstance(value, dict):
        for k, x in value.items():
            if isinstance(x, (dict, list)):
                _walk(x, f"{path}.{k}" if path else k, parent, out, f"{table}.{k}" if table else k)
    else:
        for i, x in enumerate(value):
            p = f"{path}[{i}]"
            if isinstance(x, dict):
                out.append((p, parent, i, table + ITEM, json.dumps(x)))
                _walk(x, p, p, out, table + ITEM)
            elif isinstance(x, list):
                _walk(x, p, parent, out, table + ITEM)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows = [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if (v := _loads(t)) is not None:
                n = len(rows)
                rows.append(("", None, None, "", json.dumps(v)))
                _walk(v, "", "", rows)
                ids += [i] * (len(rows) - n)
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())))], ["row", "item_path", "parent_path", "place", "kind_path", "json"])


class _Level:
    """What the merged schema says about the objects of one array path: its own array paths."""

    def __init__(self, base: tuple[str, ...]) -> None:
        self.base = base
        self.arrays: dict[tuple[str, ...], list[tuple[int, int]]] = {}  # keys -> [(depth, kinds)]


def _levels(paths: dict[tuple[str, ...], int]) -> tuple[list[_Level], int]:
    bases = [(), *sorted(p for p, k in paths.items() if k & 1)]
    levels = {b: _Level(b) for b in bases}
    deepest = 0
    for p, kinds in sorted(paths.items()):
        if not kinds & 1:
            continue
        depth = next(i for i, x in enumerate([*reversed(p), ""]) if x != ITEM)
        # The nearest object around: strip the trailing [] one by one, then whole object steps.
        for d in range(1, depth + 1):
            base = p[: len(p) - d]
            if d < depth and paths.get(base, 0) & 1 == 0:
                continue
            if d < depth:
                continue
            cut = max((i + 1 for i, x in enumerate(base) if x == ITEM), default=0)
            owner, keys = base[:cut], base[cut:]
            levels[owner].arrays.setdefault(keys, []).append((d, kinds))
    for b in bases:
        deepest = max(deepest, _height(b, levels))
    return [levels[b] for b in bases], deepest


def _height(base: tuple[str, ...], levels: dict) -> int:
    """How many object levels stand at and above this path."""
    return 0 if not base else 1 + _height(_owner(base), levels)


def _owner(base: tuple[str, ...]) -> tuple[str, ...]:
    p = base
    while p and p[-1] == ITEM:
        p = p[:-1]
    cut = max((i + 1 for i, x in enumerate(p) if x == ITEM), default=0)
    return p[:cut]


def _elements(node: Column, keys: tuple[str, ...], depth: int) -> Column:
    """array<struct<suffix, place, node>> of the elements ``depth`` arrays deep under the keys."""
    names = [k.replace("\0[]", "[]") for k in keys]
    got = F.try_variant_get(node, path_of(*names), "array<variant>")
    label = ".".join(names)
    rows = F.transform(got, lambda x, i: F.struct(F.concat(F.lit(label + "["), i.cast("string"), F.lit("]")).alias("suffix"), i.alias("place"), x.alias("node")))
    for _ in range(depth - 1):
        rows = F.flatten(
            F.transform(
                rows,
                lambda r: F.transform(
                    F.coalesce(F.try_variant_get(r["node"], "$", "array<variant>"), F.array().cast("array<variant>")),
                    lambda x, i: F.struct(F.concat(r["suffix"], F.lit("["), i.cast("string"), F.lit("]")).alias("suffix"), i.alias("place"), x.alias("node")),
                ),
            )
        )
    return rows


_ROW = "array<struct<tid:int,item_path:string,parent_path:string,place:int,node:variant>>"


def _children(levels: list[_Level], ids: dict[tuple[str, ...], int]) -> Column:
    """For a row (tid, item_path, node): its children as an array of rows."""
    node, here = F.col("c.node"), F.col("c.item_path")
    dot = F.when(here == "", "").otherwise(F.concat(here, F.lit(".")))
    out = None
    for level in levels:
        parts = []
        for keys, depths in level.arrays.items():
            for depth, kinds in depths:
                tid = ids[(*level.base, *keys, *[ITEM] * depth)]
                found = _elements(node, keys, depth)
                if kinds != 1 or depth > 1:
                    found = F.filter(found, lambda r: is_object(r["node"]))
                joint = F.coalesce(F.transform(found, lambda r: F.struct(F.lit(tid).alias("tid"), F.concat(dot, r["suffix"]).alias("item_path"), here.alias("parent_path"), r["place"].alias("place"), r["node"].alias("node"))), F.array().cast(_ROW))
                parts.append(joint)
        if parts:
            test, value = F.col("c.tid") == ids[level.base], F.concat(*parts) if len(parts) > 1 else parts[0]
            out = F.when(test, value) if out is None else out.when(test, value)
    return out


def explode_objects(df: DataFrame, row: str, column: str, nodes: bool = True, max_paths: int = MAX_PATHS, root: bool = False) -> DataFrame:
    """(row, item_path, parent_path, place, kind_path, node): every object that is an element of an array.

    ``kind_path`` is the path without positions, the name of the flat table the row belongs to
    has ``[]`` for each. Paths start inside the record: ``a[0].b.c[2]``. Without ``nodes`` the
    objects themselves are left behind as soon as their children are out, and ``node`` is null.
    With ``root`` the record itself is a row too: empty paths, no parent, no place.
    """
    paths = {tuple(json.loads(r["path"])): r["kinds"] for r in merged_schema(df, column).limit(max_paths + 1).collect()}
    if len(paths) > max_paths:
        walked = df.select(F.col(row).cast("bigint"), F.col(column).cast("string")).mapInArrow(_walked, "row bigint, item_path string, parent_path string, place int, kind_path string, json string")
        return walked.where("true" if root else "parent_path is not null").select("row", "item_path", "parent_path", "place", "kind_path", (F.try_parse_json("json") if nodes else F.lit(None).cast("variant")).alias("node"))
    levels, deepest = _levels(paths)
    ids = {x.base: i for i, x in enumerate(levels)}
    at = df.select(
        F.col(row).cast("bigint").alias("row"),
        F.struct(F.lit(0).alias("tid"), F.lit("").alias("item_path"), F.lit(None).cast("string").alias("parent_path"), F.lit(None).cast("int").alias("place"), parse_object(F.col(column).cast("string")).alias("node")).alias("c"),
    )
    at = at.where("c.node is not null") if root else at
    heights = {x.base: _height(x.base, ids) for x in levels}
    empty = F.lit(None).cast("variant")
    for k in range(deepest):
        done = [ids[x.base] for x in levels if heights[x.base] <= k]
        kids = _children([x for x in levels if heights[x.base] == k], ids)
        self_ = F.array(F.col("c") if nodes else F.when(F.col("c.tid").isin(done), F.col("c").withField("node", empty)).otherwise(F.col("c"))).cast(_ROW)
        at = at.select("row", F.explode(F.concat(self_, F.coalesce(kids, F.array().cast(_ROW)))).alias("c"))
        at = at.where("c.tid > 0") if k == 0 and not root else at
    if not deepest and not root:
        at = at.where("false")
    names = F.array(*(F.lit(_name(x.base)) for x in levels))
    return at.select("row", "c.item_path", "c.parent_path", "c.place", F.element_at(names, F.col("c.tid") + 1).alias("kind_path"), (F.col("c.node") if nodes else empty).alias("node"))


def _name(base: tuple[str, ...]) -> str:
    return reduce(lambda s, k: s + ITEM if k == ITEM else (f"{s}.{k}" if s else k).replace("\0[]", "[]"), base, "")


#: Plain objects inside one another, and arrays directly inside one another, whose fields are given as fields; what lies deeper is JSON text.
DEEP = 8

_FIELD = "array<struct<place:string,part:string,field:string,node:variant>>"


def _grown(fields: Column, go_on: Callable[[Column], Column], parts: Callable[[Column], Column]) -> Column:
    """Each field for which ``go_on`` holds replaced by its parts."""
    return F.flatten(F.transform(fields, lambda f: F.when(go_on(f), parts(f)).otherwise(F.array(f)).cast(_FIELD)))


def own_fields(df: DataFrame, row: str, column: str, max_paths: int = MAX_PATHS) -> DataFrame:
    """(row, table_name, item_path, parent_path, field, kind, text, number): every value of every flat table.

    The record is a row of the table ``''``. Fields of plain objects inside a row are fields of the row, their keys
    joined by dots; objects in arrays are rows of the array's table and not repeated here, and values in arrays are
    rows of it too, with an empty field. Nulls have no row. ``kind`` is string, number or boolean (json beyond DEEP),
    ``number`` has numbers, ``text`` has the others.
    """
    found = explode_objects(df, row, column, max_paths=max_paths, root=True)
    entry = lambda place, part, field, node: F.struct(place.alias("place"), part.alias("part"), field.alias("field"), node.alias("node"))
    none = F.lit("")
    pairs = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    fields = F.transform(pairs(F.col("node")), lambda e: entry(none, none, e["key"], e["value"])).cast(_FIELD)
    for _ in range(DEEP):
        fields = _grown(fields, lambda f: is_object(f["node"]), lambda f: F.transform(pairs(f["node"]), lambda e: entry(none, none, F.concat(f["field"], F.lit("."), e["key"]), e["value"])))
    # Arrays: objects in them are rows already, whatever else is in them becomes rows of their table.
    is_array = lambda f: F.schema_of_variant(f["node"]).startswith("ARRAY")
    items = lambda f: F.filter(
        F.transform(
            F.try_variant_get(f["node"], "$", "array<variant>"),
            lambda x, i: entry(F.concat(F.when(f["part"] == "", f["field"]).otherwise(f["place"]), F.lit("["), i.cast("string"), F.lit("]")), F.concat(F.when(f["part"] == "", f["field"]).otherwise(f["part"]), F.lit("[]")), none, x),
        ),
        lambda f: ~F.coalesce(is_object(f["node"]), F.lit(False)),
    )
    for _ in range(DEEP):
        fields = _grown(fields, is_array, items)
    at = found.select("row", "kind_path", "item_path", "parent_path", F.explode(fields).alias("f")).withColumn("bit", kind_bit(F.col("f.node"))).where("bit > 0")
    dotted = lambda base, more: F.when(F.col(more) == "", F.col(base)).when(F.col(base) == "", F.col(more)).otherwise(F.concat(base, F.lit("."), more))
    number = F.col("bit").bitwiseAND(NUMBER) != 0
    kind = F.when(number, "number").when(F.col("bit") == STRING, "string").when(F.col("bit") == BOOLEAN, "boolean").otherwise("json")
    return at.select(
        "row", dotted("kind_path", "f.part").alias("table_name"), dotted("item_path", "f.place").alias("item_path"),
        F.when(F.col("f.part") == "", F.coalesce("parent_path", F.lit(""))).otherwise(F.col("item_path")).alias("parent_path"), F.col("f.field").alias("field"), kind.alias("kind"),
        F.when(~number, F.when(F.col("bit").isin(ARRAY, OBJECT), F.to_json("f.node")).otherwise(F.try_variant_get("f.node", "$", "string"))).alias("text"), F.when(number, F.try_variant_get("f.node", "$", "double")).alias("number"),
    )


def field_types(fields: DataFrame) -> DataFrame:
    """(table_name, field, kinds): of rows as from :func:`own_fields`, each table's fields and the sorted set of their kinds."""
    return fields.groupBy("table_name", "field").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def flat_table(df: DataFrame, row: str, column: str, name: str, types: list[tuple[str, list[str]]]) -> DataFrame:
    """One flat table: (row, parent_path, item_path, place) and a column a field, typed by the kinds it has.

    ``types`` are the table's (field, kinds); a field of one kind is a double, boolean or string, a mixed one is text.
    Columns are named by their fields with ``__`` for dots.
    """
    rows = explode_objects(df, row, column, root=True).where(F.col("kind_path") == name)
    taken, columns = {"row", "parent_path", "item_path", "place"}, []
    for field, kinds in sorted(types):
        if not field:
            continue
        alias = field.replace(".", "__")
        while alias.lower() in taken:
            alias += "_"
        taken.add(alias.lower())
        x = F.try_variant_get("node", path_of(*field.split(".")), "variant")
        bit = kind_bit(x)
        if kinds == ["number"]:
            value = F.when(bit.bitwiseAND(NUMBER) != 0, F.try_variant_get(x, "$", "double"))
        elif kinds == ["boolean"]:
            value = F.when(bit == BOOLEAN, F.try_variant_get(x, "$", "boolean"))
        else:
            value = F.when((bit == STRING) if kinds == ["string"] else bit.bitwiseAND(F.lit(ARRAY | OBJECT)) == 0, F.try_variant_get(x, "$", "string"))
        columns.append(value.alias(alias))
    return rows.select("row", F.coalesce("parent_path", F.lit("")).alias("parent_path"), "item_path", "place", *columns)


def flat_tables(df: DataFrame, row: str, column: str) -> dict[str, DataFrame]:
    """Every flat table by name, the records' own under ``''``. The names and types of fields, metadata, are collected."""
    types: dict[str, list[tuple[str, list[str]]]] = {}
    for r in field_types(own_fields(df, row, column)).collect():
        types.setdefault(r["table_name"], []).append((r["field"], r["kinds"]))
    return {name: flat_table(df, row, column, name, types[name]) for name in sorted(types)}
