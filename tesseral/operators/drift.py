"""Schemas that drift between the files of a stream.

Every file's schema is read in parallel: one partial aggregation over its lines gives, for each
field, the set of JSON kinds as bits. The bits are a lattice under bitwise or, whose joins are
the type promotions; folding all files through it gives the union schema, to which every line is
cast. Consecutive files are compared as tables, level by level.

Defined cases
- a line that is not one complete JSON object does not count; a file without any other line is
  passed over, as is a file missing from the registry;
- a field is present in a file where it has a value other than null; its type is the set of its kinds;
- files of a stream with equal ``opened_at`` stand in the order of their id, null times last, and a
  null stream is a stream of its own;
- empty tables give no changes, and a table with the key columns only.

Sizes: fields are metadata and few; a hot file or stream shrinks by partial aggregation to its
fields before it is shuffled, and the order of files is taken on the registry alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions.variant import BOOLEAN, DOUBLE, LONG, NUMBER, OBJECT, STRING, kind_bit, parse_object, path_of
from tesseral.session import cut

#: Columns the union table may have; the fields beyond go whole into the map column ``more_fields``.
MAX_COLUMNS = 2000


def file_schemas(lines: DataFrame, file_id: str = "file_id", line: str = "line") -> DataFrame:
    """(file_id, outer, inner, kinds): the fields of each file; inner is null for a top field.

    A file with lines that count but hold no value, as in ``{}``, has a row with a null outer and no kinds.
    """
    spark = lines.sparkSession
    v = lines.select(F.col(file_id).alias("file_id"), parse_object(F.col(line)).alias("_v")).where("_v is not null")
    top = v.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer())).select("file_id", F.col("key").alias("outer"), F.col("value").alias("_x")).withColumn("kind", F.coalesce(kind_bit(F.col("_x")), F.lit(0))).withColumn("outer", F.when(F.col("kind") > 0, F.col("outer")))
    deep = top.where(F.col("kind") == OBJECT).lateralJoin(spark.tvf.variant_explode(F.col("_x").outer())).select("file_id", "outer", F.col("key").alias("inner"), kind_bit(F.col("value")).alias("kind")).where("kind > 0")
    rows = top.select("file_id", "outer", F.lit(None).cast("string").alias("inner"), "kind").unionByName(deep)
    return rows.groupBy("file_id", "outer", "inner").agg(F.bit_or("kind").alias("kinds"))


def successions(files: DataFrame, used: DataFrame, file_id: str = "file_id", stream: str = "stream", opened: str = "opened_at") -> DataFrame:
    """(file_id, next_id, stream, place): the files of ``used`` in the order of their stream."""
    w = Window.partitionBy("stream").orderBy(F.col("opened").asc_nulls_last(), "file_id")
    f = files.select(F.col(file_id).alias("file_id"), F.col(stream).alias("stream"), F.col(opened).alias("opened")).dropDuplicates(["file_id"])
    return f.join(used.select("file_id").distinct(), "file_id").select("file_id", "stream", F.lead("file_id").over(w).alias("next_id"), F.row_number().over(w).alias("place"))


def _compare(pairs: DataFrame, level: list[str], name: str) -> DataFrame:
    """Per pair and parent: rows (name_old, name_new, old_kinds, new_kinds) of what is gone, new or both.

    ``pairs`` has one row per (pair, parent, name) with old and new kinds. A lone vanished field
    and a lone new one of one type become one row with both names.
    """
    by = F.struct(name, "old", "new")
    gone, come = F.col("new").isNull(), F.col("old").isNull()
    lone = (
        pairs.where(gone | come)
        .groupBy(*level)
        .agg(F.count_if(gone).alias("n_gone"), F.count_if(come).alias("n_come"), F.min(F.when(gone, by)).alias("g"), F.min(F.when(come, by)).alias("c"))
        .where("n_gone = 1 and n_come = 1 and g.old = c.new")
    )
    renamed = lone.select(*level, F.col(f"g.{name}").alias("name_old"), F.col(f"c.{name}").alias("name_new"), F.col("g.old").alias("old"), F.col("c.new").alias("new"))
    rest = pairs.join(renamed.select(*level, F.lit(True).alias("_r")), level, "left").where((F.col("_r").isNull()) | ~(gone | come))
    plain = rest.select(*level, F.when(~come, F.col(name)).alias("name_old"), F.when(~gone, F.col(name)).alias("name_new"), "old", "new")
    return plain.unionByName(renamed)


def _change() -> Column:
    return (
        F.when(F.col("name_new").isNull(), "removed").when(F.col("name_old").isNull(), "added").when(F.col("name_old") != F.col("name_new"), "renamed").when(F.col("old") != F.col("new"), "retyped")
    )


def schema_changes(lines: DataFrame, files: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(file_id, stream, place, change, old_path, new_path): each change, with the later file."""
    schemas = cut(file_schemas(lines)) if schemas is None else schemas
    kinds = F.when(F.col("kinds").bitwiseAND(NUMBER) != 0, F.col("kinds").bitwiseOR(F.lit(NUMBER))).otherwise(F.col("kinds"))
    schemas = schemas.withColumn("kinds", kinds)
    order = successions(files, schemas)
    schemas = schemas.where("outer is not null")
    # Every file is the new side of its own comparison and the old side of its successor's.
    sides = F.explode(F.array(F.struct(F.col("file_id").alias("pair"), F.lit(True).alias("is_new")), F.struct(F.col("next_id").alias("pair"), F.lit(False).alias("is_new"))))
    sided = schemas.join(order, "file_id").select(sides.alias("s"), "outer", "inner", "kinds").select("s.*", "outer", "inner", "kinds").where("pair is not null")
    later = order.where("place > 1").select(F.col("file_id").alias("pair"), "stream", "place")
    # Fields by file, far fewer than lines, and read by every branch below.
    sided = cut(sided.join(later, "pair"))
    old, new = F.max(F.when(~F.col("is_new"), F.col("kinds"))), F.max(F.when(F.col("is_new"), F.col("kinds")))

    top = sided.where("inner is null").groupBy("pair", "outer").agg(old.alias("old"), new.alias("new"))
    tops = _compare(top, ["pair"], "outer")
    # A parent holds objects on both sides; inside, both names of it are one.
    parents = tops.where((F.col("old").bitwiseAND(OBJECT) != 0) & (F.col("new").bitwiseAND(OBJECT) != 0)).select("pair", F.col("name_old").alias("parent_old"), F.col("name_new").alias("parent_new"))
    both = F.explode(F.array(F.struct(F.lit(False).alias("is_new"), F.col("parent_old").alias("outer")), F.struct(F.lit(True).alias("is_new"), F.col("parent_new").alias("outer"))))
    inner = (
        sided.where("inner is not null")
        .join(parents.select("pair", "parent_old", "parent_new", both.alias("b")).select("pair", "parent_old", "parent_new", "b.*"), ["pair", "is_new", "outer"])
        .groupBy("pair", "parent_old", "parent_new", "inner")
        .agg(old.alias("old"), new.alias("new"))
    )
    inners = _compare(inner, ["pair", "parent_old", "parent_new"], "inner")
    rows = tops.select("pair", _change().alias("change"), F.col("name_old").alias("old_path"), F.col("name_new").alias("new_path")).unionByName(
        inners.select("pair", _change().alias("change"), F.concat("parent_old", F.lit("."), "name_old").alias("old_path"), F.concat("parent_new", F.lit("."), "name_new").alias("new_path"))
    )
    return (
        rows.where("change is not null")
        .join(later, "pair")
        .select(F.col("pair").alias("file_id"), "stream", "place", "change", F.coalesce("old_path", F.lit("")).alias("old_path"), F.coalesce("new_path", F.lit("")).alias("new_path"))
    )


def promoted(kinds: int) -> str:
    """The least type that holds values of all these kinds; JSON text where nothing smaller does."""
    return {LONG: "bigint", DOUBLE: "double", LONG | DOUBLE: "double", BOOLEAN: "boolean"}.get(kinds, "string")


def _classes(renames: list[tuple[str, str]], together: set[tuple[str, str]], kinds: dict[str, int]) -> dict[str, list[str]]:
    """Names that are one field: joined by renames, never in one file together. Keyed by the least name."""
    member = {n: [n] for n in kinds}
    for a, b in sorted(renames):
        x, y = member.get(a), member.get(b)
        if x is None or y is None or x is y or any((min(p, q), max(p, q)) in together for p in x for q in y):
            continue
        x += y
        for n in y:
            member[n] = x
    return {min(m): sorted(m) for m in member.values()}


def union_table(lines: DataFrame, files: DataFrame, keys: list[str] | None = None, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """Every counted line in one schema: a column a field, renamed fields in one column.

    Objects held by every file that has the field become columns ``outer__inner``; what is mixed or an array
    stays as JSON text. ``more_fields`` maps any field beyond ``max_columns`` to its JSON text.
    The names and kinds of fields, the renames, and which renamed ones stand in one file, are the only
    things brought to the driver: metadata whose size is that of the fields' vocabulary.
    """
    keys = keys or ["line_id", "file_id", "line_no"]
    schemas = cut(file_schemas(lines))
    flat = schemas.where("outer is not null").select("file_id", "outer", "inner", "kinds")
    fields = {(r["outer"], r["inner"]): r["kinds"] for r in flat.groupBy("outer", "inner").agg(F.bit_or("kinds").alias("kinds")).collect()}
    tops = {o: k for (o, i), k in fields.items() if i is None}
    renames = [tuple(r) for r in schema_changes(lines, files, schemas).where("change = 'renamed' and not contains(old_path, '.')").select("old_path", "new_path").distinct().collect()]
    # Only fields that were renamed may be one column, so only of these it matters which stand in one file.
    moved = flat.where(F.col("inner").isNull() & F.col("outer").isin(sorted({n for pair in renames for n in pair}) or [""]))
    a, b = moved.select("file_id", F.col("outer").alias("a")), moved.select("file_id", F.col("outer").alias("b"))
    together = {tuple(r) for r in a.join(b, "file_id").where("a < b").select("a", "b").distinct().collect()}
    v = F.col("_v")
    columns, more, taken = [], [], {k.lower() for k in [*keys, "more_fields"]}

    def add(name: str, value: Column) -> bool:
        if len(columns) >= max_columns:
            return False
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns.append(value.alias(name))
        return True

    def leaf(path: str, kinds: int) -> Column:
        kind = promoted(kinds)
        if kind != "string":
            return F.try_variant_get(v, path, kind)
        x = F.try_variant_get(v, path, "variant")
        return F.try_variant_get(v, path, "string") if kinds == STRING else F.when(F.schema_of_variant(x) != "VOID", F.to_json(x))

    for name, names in sorted(_classes(renames, together, tops).items()):
        kinds = 0
        for n in names:
            kinds |= tops[n]
        if kinds == OBJECT:
            for inner in sorted({i for (o, i) in fields if o in names and i is not None}):
                held = [n for n in names if (n, inner) in fields]
                k = 0
                for n in held:
                    k |= fields[n, inner]
                if not add(f"{name}__{inner}", F.coalesce(*(leaf(path_of(n, inner), k) for n in held))):
                    more += [(f"{n}.{inner}", path_of(n, inner)) for n in held]
        elif not add(name, F.coalesce(*(leaf(path_of(n), kinds) for n in names))):
            more += [(n, path_of(n)) for n in names]
    rest = [x for n, p in more for x in (F.lit(n), F.to_json(F.try_variant_get(v, p, "variant")))]
    all_more = F.map_filter(F.create_map(*rest), lambda _, x: x.isNotNull()) if rest else F.lit(None).cast("map<string,string>")
    parsed = lines.select(*keys, parse_object(F.col("line")).alias("_v")).where("_v is not null")
    return parsed.select(*keys, *columns, all_more.alias("more_fields"))
