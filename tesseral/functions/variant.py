"""Reading JSON text through VARIANT without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the JSON kinds a value can have; whole and broken numbers are one kind but two types.
LONG, DOUBLE, STRING, BOOLEAN, ARRAY, OBJECT = 1, 2, 4, 8, 16, 32
NUMBER = LONG | DOUBLE


def is_object(v: Column) -> Column:
    """True where the variant is a JSON object; null for null."""
    return F.schema_of_variant(v).startswith("OBJECT")


def parse_object(text: Column) -> Column:
    """The text as a VARIANT if it is one complete JSON object, else null.

    Text after the object makes it incomplete, as does a repeated key (VARIANT has none).
    """
    space = F.lit(" \t\r\n")
    return F.try_parse_json(F.when(F.ltrim(text, space).startswith("{") & F.rtrim(text, space).endswith("}"), text))


def kind_bit(v: Column) -> Column:
    """The kind of a variant value as one of the bits above; 0 for null."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), OBJECT)
        .when(s.startswith("ARRAY"), ARRAY)
        .when(s == "STRING", STRING)
        .when(s == "BOOLEAN", BOOLEAN)
        .when(s == "BIGINT", LONG)
        .when(s.isNull() | (s == "VOID"), 0)
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), DOUBLE)
        .otherwise(STRING)
    )


def path_of(*keys: str) -> str:
    """A variant path to nested keys, whatever characters they hold (quotes of one sort at most)."""
    return "$" + "".join(f'["{k}"]' if '"' not in k else f"['{k}']" for k in keys)


def text_at(v: Column, *keys: str) -> Column:
    """The value under the keys as text if it is a JSON string, else null."""
    x = F.try_variant_get(v, path_of(*keys), "variant")
    return F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))


def items_at(v: Column, *keys: str) -> Column:
    """The value under the keys as an array of variants if it is a JSON array, else null."""
    return F.try_variant_get(v, path_of(*keys), "array<variant>")
