"""Entity source text from the schemas of stored tables."""

from __future__ import annotations

import keyword
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NAMES = {T.BooleanType: "boolean", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "binary", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp_ntz", T.DateType: "date"}


def kind_of(t: T.DataType) -> str | None:
    """The field type that a Spark type maps to, or None."""
    if isinstance(t, T.DecimalType):
        return f"decimal({t.precision},{t.scale})"
    if isinstance(t, T.ArrayType):
        inner = NAMES.get(type(t.elementType))
        return inner and f"array<{inner}{'?' if t.containsNull else ''}>"
    return NAMES.get(type(t))


def identifier(name: str) -> str:
    name = re.sub(r"\W", "_", name)
    return f"{name}_" if keyword.iskeyword(name) or not name or name[0].isdigit() else name


def source_of(tables: dict[str, DataFrame | T.StructType], keys: dict[str, list[str]] | None = None, foreign: dict[str, dict[str, str]] | None = None) -> str:
    """Python source that declares an entity for each table.

    keys lists primary keys; foreign maps a table's column to the table it refers to. Columns of types without a
    field type, and keys of several columns as association targets, become TODO comments.
    """
    out = ["from relq.sources import Entity, Field, belongs_to", ""]
    cls = lambda n: "".join(p.capitalize() for p in re.split(r"[_\W]+", n))
    for name in sorted(tables):
        schema = tables[name] if isinstance(tables[name], T.StructType) else tables[name].schema
        own = (keys or {}).get(name, [])
        out += ["", f'class {cls(name)}(Entity, table="{name}"):']
        for f in schema:
            kind, options = kind_of(f.dataType), ""
            if kind is None:
                out.append(f"    # TODO {f.name}: {f.dataType.simpleString()} has no field type")
                continue
            attribute = identifier(f.name)
            options += ", nullable=True" * (f.nullable and f.name not in own) + ", key=True" * (f.name in own) + f', column="{f.name}"' * (attribute != f.name)
            out.append(f'    {attribute} = Field("{kind}"{options})')
        for column, target in sorted((foreign or {}).get(name, {}).items()):
            if len((keys or {}).get(target, [""])) > 1:
                out.append(f"    # TODO {column} refers to {target}, whose key has several columns")
            else:
                out.append(f'    {identifier(re.sub("_?(id|key)$", "", column) or target)}_row = belongs_to(lambda: {cls(target)}, "{column}")')
    return "\n".join(out) + "\n"
