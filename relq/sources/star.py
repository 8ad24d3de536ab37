"""Entities of the benchmark's star schema."""

from __future__ import annotations

from .entity import Entity, Field, belongs_to, has_many, has_one


class Region(Entity, table="region"):
    r_regionkey = Field("int", key=True)
    r_name = Field("string")


class Nation(Entity, table="nation"):
    n_nationkey = Field("int", key=True)
    n_name = Field("string")
    n_regionkey = Field("int")


class Customer(Entity, table="customer"):
    c_custkey = Field("long", key=True)
    c_name = Field("string")
    c_nationkey = Field("int")
    c_acctbal = Field("double")
    c_mktsegment = Field("string")
    orders = has_many(lambda: Orders, "o_custkey")
    latest_order = has_one(lambda: Orders, "o_custkey")
    nation = belongs_to(lambda: Nation, "c_nationkey")


class Supplier(Entity, table="supplier"):
    s_suppkey = Field("long", key=True)
    s_name = Field("string")
    s_nationkey = Field("int")
    s_acctbal = Field("double")


class Part(Entity, table="part"):
    p_partkey = Field("long", key=True)
    p_name = Field("string")
    p_brand = Field("string")
    p_type = Field("string")
    p_size = Field("int")
    p_retailprice = Field("double")


class Lineitem(Entity, table="lineitem"):
    l_orderkey = Field("long")
    l_partkey = Field("long")
    l_suppkey = Field("long")
    l_linenumber = Field("int")
    l_quantity = Field("double")
    l_extendedprice = Field("double")
    l_discount = Field("double")
    l_tax = Field("double")
    l_returnflag = Field("string")
    l_linestatus = Field("string")
    l_shipdate = Field("timestamp_ntz")


class Orders(Entity, table="orders", filterable=("o_orderstatus", "o_custkey", "o_orderpriority", "o_totalprice")):
    o_orderkey = Field("long", key=True)
    o_custkey = Field("long")
    o_orderstatus = Field("string", labels=("F", "O", "P"))
    o_totalprice = Field("double")
    o_orderdate = Field("timestamp_ntz")
    o_orderpriority = Field("string")
    parts = has_many(Part, "", through=(Lineitem, "l_orderkey", "l_partkey"))
    customer = belongs_to(Customer, "o_custkey")


class Event(Entity, table="events"):
    event_id = Field("long", key=True)
    ts = Field("timestamp_ntz")
    user_id = Field("long")
    event_type = Field("string")
    value = Field("double")
    props = Field("json")


class FiledOrder(Entity, table="filed_orders"):
    """Orders with two derived columns: a priority that may be null, and the deletion time of finished ones."""

    o_orderkey = Field("long", key=True)
    o_custkey = Field("long")
    o_totalprice = Field("double")
    priority = Field("string", nullable=True)
    deleted_at = Field("timestamp_ntz", nullable=True, deleted=True)


class Node(Entity, table="nodes"):
    """Parts as a tree shaped like a heap: the parent of key k is k div 2, key 1 is the root, key 0 is left out."""

    id = Field("long", key=True)
    parent_id = Field("long", nullable=True)
    size = Field("int")
    parent = belongs_to(lambda: Node, "parent_id")
    children = has_many(lambda: Node, "parent_id")


class Edge(Entity, table="walk_nodes"):
    """A graph with a cycle: root -> b -> c -> root."""

    id = Field("string", key=True)
    parent_id = Field("string", nullable=True)


class Note(Entity, table="notes", unique={"notes_name": ("name",)}):
    """Rows with a generated key and a version, for writes."""

    id = Field("long", key=True, generated=True)
    name = Field("string")
    version = Field("long", version=True)


class Debtor(Entity, table="debtors"):
    """Suppliers with a derived flag, null for those of one nation."""

    s_suppkey = Field("long", key=True)
    in_debt = Field("boolean", nullable=True)


class HeldNation(Entity, table="relq_nation", schema="global_temp"):
    """Nations as a table of one of Spark's schemas."""

    n_nationkey = Field("int", key=True)
    n_name = Field("string")
    n_regionkey = Field("int")
