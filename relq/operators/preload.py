"""Associations loaded inside the plan: children grouped to arrays and joined to their parents once."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import RelqError
from .query import Query


def _one_key(entity: Any, named: str | None) -> str:
    return named or entity.primary_key()[0]


def _child(compiler: Any, a: Any, tune: Any) -> tuple[Query, DataFrame]:
    q = Query.of(a.entity())
    q = tune(q) if tune else q
    if q.selection:
        raise RelqError(None, "a preloaded query cannot project")
    return q, compiler.query(q)


def _ordering(q: Query, df: DataFrame) -> list:
    """The child query's own order, then its key, as columns of its frame."""
    from ..plans.compiler import placed

    terms = [placed(F.col(f"`{o.args[0].args[1]}`"), o) for o in q.order if o.args[0].op == "column"]
    return terms + [F.col(f"`{k}`").asc_nulls_last() for k in q.entity.primary_key()]


def preloaded(compiler: Any, df: DataFrame, q: Query) -> DataFrame:
    """df, the base entity's rows, with one more column for each association.

    has_many gives an array, empty where there are no children; has_one a struct or null, the first by the child's
    order; belongs_to a struct, null only where the key is null: a key without its row is an error when it runs.
    """
    for name, tune in q.preloads:
        a = q.entity.__associations__[name]
        child, rows = _child(compiler, a, tune)
        row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
        if a.kind == "belongs_to":
            to = _one_key(a.entity(), a.references)
            side = rows.select(F.col(to).alias("__to"), row.alias(name))
            df = df.join(side, df[a.key] == side["__to"], "left")
            lost = F.col(name).isNull() & F.col(a.key).isNotNull()
            said = F.raise_error(F.concat(F.lit(f"dangling reference: {name} of key "), F.col(a.key).cast("string")))
            df = df.withColumn(name, F.when(lost, said.cast(side.schema[name].dataType)).otherwise(F.col(name))).drop("__to")
            continue
        own = _one_key(q.entity, a.references)
        if a.through:
            link, parent, target = a.through
            links = compiler.catalog.frame(link).select(F.col(parent).alias("__from"), F.col(target).alias("__link"))
            rows = links.join(rows, links["__link"] == rows[_one_key(a.entity(), None)]).drop("__link")
        else:
            rows = rows.withColumn("__from", F.col(a.key))
        rows = rows.where(F.col("__from").isNotNull())
        if a.kind == "has_many" and not child.order:  # by key alone: sorted where they are gathered
            keys = [F.col(f"`{k}`") for k in child.entity.primary_key()]
            rows = rows.select("__from", F.struct(*(k.alias(f"__k{i}") for i, k in enumerate(keys)), row.alias("__row")).alias("__one"))
            lists = rows.groupBy("__from").agg(F.sort_array(F.collect_list("__one")).alias("__rows"))
            df = _with_lists(df, lists, own, name)
            continue
        nth = F.row_number().over(W.partitionBy("__from").orderBy(*_ordering(child, rows)))
        rows = rows.select("__from", row.alias("__row"), nth.alias("__n"))
        if a.kind == "has_one":
            side = rows.where("__n = 1").select("__from", F.col("__row").alias(name))
            df = df.join(side, df[own] == side["__from"], "left").drop("__from")
            continue
        lists = rows.groupBy("__from").agg(F.sort_array(F.collect_list(F.struct("__n", "__row"))).alias("__rows"))
        df = _with_lists(df, lists, own, name)
    return df


def _with_lists(df: DataFrame, lists: DataFrame, own: str, name: str) -> DataFrame:
    side = lists.select("__from", F.transform("__rows", lambda x: x["__row"]).alias(name))
    df = df.join(side, df[own] == side["__from"], "left").drop("__from")
    return df.withColumn(name, F.coalesce(F.col(name), F.array().cast(side.schema[name].dataType)))
