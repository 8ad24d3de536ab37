"""Entities: classes that declare a table's columns, keys and associations."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import RelqError
from ..functions.expr import Expr

#: Types of fields by their short names.
TYPES = {
    "boolean": T.BooleanType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "uuid": T.StringType(),
    "binary": T.BinaryType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "date": T.DateType(), "time": T.LongType(), "json": T.StringType(),
    "interval": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())]),
}


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


class Field:
    """A column: its type (a name of TYPES, decimal(p,s), array<t>, or a Spark type) and what it is for.

    labels lists an enum's allowed values; json and interval fields are described in TYPES.
    """

    def __init__(self, kind: Any, *, column: str | None = None, nullable: bool = False, key: bool = False, generated: bool = False, deleted: bool = False, labels: tuple[str, ...] = (), version: bool = False) -> None:
        self.kind, self.nullable, self.key, self.generated, self.deleted, self.labels, self.version = kind, nullable, key, generated, deleted, labels, version
        self.type = kind if isinstance(kind, T.DataType) else TYPES.get(kind) or T._parse_datatype_string(kind) if not str(kind).startswith(("decimal", "array")) else _parsed(str(kind))
        self.column = column
        self.name = ""

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name
        self.column = self.column or snake(name)

    def __get__(self, instance: Any, owner: type) -> Any:
        return self if instance is not None else Expr("column", (owner.__table__, self.column), self.type)


def _parsed(kind: str) -> T.DataType:
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", kind):
        return T.DecimalType(int(m[1]), int(m[2]))
    if m := re.fullmatch(r"array<(\w+)(\?)?>", kind):
        return T.ArrayType(TYPES[m[1]], bool(m[2]))
    raise ValueError(f"no type {kind!r}")


@dataclass(frozen=True)
class Association:
    """kind: has_many, has_one or belongs_to. through: (entity, its key to the parent, its key to the child)."""

    kind: str
    target: Any
    key: str
    references: str | None = None
    through: tuple | None = None

    def entity(self) -> type:
        return self.target if isinstance(self.target, type) else self.target()


def has_many(target: Any, key: str, references: str | None = None, through: tuple | None = None) -> Association:
    return Association("has_many", target, key, references, through)


def has_one(target: Any, key: str, references: str | None = None) -> Association:
    return Association("has_one", target, key, references)


def belongs_to(target: Any, key: str, references: str | None = None) -> Association:
    return Association("belongs_to", target, key, references)


class Columns:
    """The columns of an entity under a name: attribute access gives column expressions."""

    def __init__(self, entity: type, alias: str) -> None:
        self._entity, self._alias = entity, alias

    def __getattr__(self, name: str) -> Expr:
        f = self._entity.__fields__.get(name)
        if f is None:
            raise AttributeError(f"{self._entity.__name__} has no field {name}")
        return Expr("column", (self._alias, f.column), f.type)


class Entity:
    """Subclass with table= (and schema=): each Field attribute is a column, each association may be preloaded.

    unique= names sets of fields whose values are unique, for targets of upserts."""

    __table__: str
    __schema_name__: str | None
    __fields__: dict[str, Field]
    __unique__: dict[str, tuple[str, ...]]
    __associations__: dict[str, Association]

    def __init_subclass__(cls, table: str | None = None, schema: str | None = None, filterable: tuple[str, ...] = (), unique: dict[str, tuple[str, ...]] | None = None, **kw: Any) -> None:
        super().__init_subclass__(**kw)
        cls.__table__ = table or snake(cls.__name__)
        cls.__schema_name__ = schema
        cls.__fields__ = {k: v for k, v in vars(cls).items() if isinstance(v, Field)}
        cls.__associations__ = {k: v for k, v in vars(cls).items() if isinstance(v, Association)}
        cls.__filterable__ = filterable
        cls.__unique__ = dict(unique or {})

    @classmethod
    def columns(cls) -> list[str]:
        return [f.column for f in cls.__fields__.values()]

    @classmethod
    def primary_key(cls) -> list[str]:
        return [f.column for f in cls.__fields__.values() if f.key]

    @classmethod
    def deleted_column(cls) -> str | None:
        return next((f.column for f in cls.__fields__.values() if f.deleted), None)

    @classmethod
    def struct(cls) -> T.StructType:
        """The declared columns; metadata tells what each is for."""
        flags = lambda f: {k: True for k in ("key", "generated", "deleted") if getattr(f, k)}
        return T.StructType([T.StructField(f.column, f.type, f.nullable, flags(f)) for f in cls.__fields__.values()])

    @classmethod
    def query(cls, alias: str | None = None):
        from ..operators.query import Query

        return Query.of(cls, alias)


def _shorthand(name: str):
    def method(cls, *args: Any, **kw: Any):
        return getattr(cls.query(), name)(*args, **kw)

    method.__doc__ = f"query().{name}(...)"
    return classmethod(method)


for _name in ("where", "select", "order_by", "limit", "group_by", "join", "left_join", "distinct", "with_deleted", "only_deleted", "preload", "filtered"):
    setattr(Entity, _name, _shorthand(_name))
setattr(Entity, "aliased", classmethod(lambda cls, name: cls.query(name)))


class Catalog:
    """Where each table is: given frames or functions that make one, else Parquet below a folder, else a table of Spark's
    catalog."""

    def __init__(self, spark: SparkSession, folder: str | None = None, frames: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.folder, self.frames = spark, folder, dict(frames or {})

    def with_frames(self, frames: dict[str, DataFrame]) -> Catalog:
        return Catalog(self.spark, self.folder, {**self.frames, **frames})

    def frame(self, entity: type) -> DataFrame:
        """The entity's declared columns; a missing one is error 4106, a type that does not fit 4107."""
        name = entity.__table__
        if name in self.frames:
            df = self.frames[name]
            df = df() if callable(df) else df
        elif entity.__schema_name__:
            df = self.spark.table(f"`{entity.__schema_name__}`.`{name}`")
        elif self.folder:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        else:
            df = self.spark.table(f"`{name}`")
        held = {f.name: f.dataType for f in df.schema}
        if missing := [c for c in entity.columns() if c not in held]:
            raise RelqError(4106, f"{name} lacks {', '.join(missing)}")
        for f in entity.__fields__.values():
            if held[f.column] != f.type and type(held[f.column]) is not type(f.type):
                raise RelqError(4107, f"{name}.{f.column} is {held[f.column].simpleString()}, declared {f.type.simpleString()}")
        return df.select(*entity.columns())
