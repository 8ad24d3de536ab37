"""The registered queries over the benchmark's tables, and the SQL that each is compared with."""

from __future__ import annotations

import enum
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RelqError
from ..functions.expr import Window, dense_rank, fragment, lag, lead, literal, rank, row_number, scalar, scalar_count, scalar_first
from ..operators.query import Raw, Recursive, combine
from ..operators.transaction import Multi, Session, transaction, with_retries
from ..operators.write import OnConflict, all_rows, removed, restored, soft_deleted, updated, upserted
from ..sources.entity import Catalog
from ..sources.shared import shared_folder
from ..sources.star import Customer, Debtor, Edge, Event, FiledOrder, HeldNation, Lineitem, Nation, Node, Note, Orders, Part, Region, Supplier
from ..sources.store import Store
from .compiler import Compiler

Made = tuple[Callable[[Compiler], DataFrame], str]
_made: dict[str, Made] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The tables of a folder, with the derived ones, which are made when a query first names them."""
    own = Catalog(spark, sf_dir)

    def filed() -> DataFrame:
        priority, deleted = F.nullif("o_orderpriority", F.lit("5-LOW")), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
        return own.frame(Orders).select("o_orderkey", "o_custkey", "o_totalprice", priority.alias("priority"), deleted.alias("deleted_at"))

    def nodes() -> DataFrame:
        parent = F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2"))
        return own.frame(Part).where("p_partkey > 0").select(F.col("p_partkey").alias("id"), parent.alias("parent_id"), F.col("p_size").alias("size"))

    debtors = lambda: own.frame(Supplier).select("s_suppkey", F.when(F.col("s_nationkey") != 7, F.col("s_acctbal") < 0).alias("in_debt"))
    edges = lambda: spark.createDataFrame([("root", "c"), ("b", "root"), ("c", "b")], "id string, parent_id string")
    return own.with_frames({"filed_orders": filed, "nodes": nodes, "walk_nodes": edges, "debtors": debtors})


FILED = "(SELECT o_orderkey, o_custkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS priority, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at FROM orders)"
NODES = "(SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent_id, p_size AS size FROM part WHERE p_partkey > 0)"


DEBTORS = "(SELECT s_suppkey, CASE WHEN s_nationkey <> 7 THEN s_acctbal < 0 END AS in_debt FROM supplier)"


def registered(name: str, sql: str):
    def add(make: Callable[[], Any]):
        _made[name] = ((lambda c: made(c) if callable(made := make()) else c.query(made)), sql)
        return make

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, f=f: f(Compiler(catalog(spark, sf_dir)))) for n, (f, _) in _made.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _made.items()}


def total(e, digits=2):
    """A sum of amounts with so many digits, as a double: rounding takes the order of additions out."""
    return e.sum().rounded(digits)


def count_rows():
    return literal(1).count()


# aggregation


@registered(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
    round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY 1, 2""",
)
def _():
    import datetime as dt

    return (
        Lineitem.where(lambda x: x.l_shipdate <= dt.datetime(1998, 9, 2))
        .group_by(lambda x: (x.l_returnflag, x.l_linestatus))
        .select(
            lambda x: {
                "l_returnflag": x.l_returnflag, "l_linestatus": x.l_linestatus, "sum_qty": total(x.l_quantity), "sum_price": total(x.l_extendedprice),
                "avg_qty": fragment("round({}, 6)", x.l_quantity.avg()), "avg_disc": fragment("round({}, 6)", x.l_discount.avg()), "n": count_rows(),
            }
        )
        .order_by(lambda x: (x.l_returnflag, x.l_linestatus))
    )


@registered("group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) > 12 AND o_custkey < 1000")
def _():
    q = Orders.group_by(lambda o: o.o_custkey).having(lambda o: (count_rows() > 12) & (o.o_custkey < 1000))
    return q.select(o_custkey=lambda o: o.o_custkey, n=count_rows(), total=lambda o: total(o.o_totalprice))


@registered("having_without_groups", "SELECT count(*) AS n, min(o_orderkey) AS low FROM orders HAVING count(*) > 10")
def _():
    return Orders.query().having(lambda o: count_rows() > 10).select(n=count_rows(), low=lambda o: o.o_orderkey.min())


@registered("filtered_aggregates", "SELECT o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 100000) AS o, max(o_totalprice) FILTER (o_orderstatus = 'P') AS top FROM orders GROUP BY 1")
def _():
    n = count_rows()
    return Orders.group_by(lambda o: o.o_orderpriority).select(
        lambda o: {"p": o.o_orderpriority, "f": n.filter(o.o_orderstatus == "F"), "o": n.filter(o.o_orderstatus == "O").filter(o.o_totalprice > 100000), "top": o.o_totalprice.max().filter(o.o_orderstatus == "P")}
    )


@registered("percentiles", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, round(median(value), 6) AS mid, round(quantile_cont(value, 0.25) FILTER (user_id % 2 = 0), 6) AS low FROM events GROUP BY 1")
def _():
    r = lambda e: fragment("round({}, 6)", e)
    return Event.group_by(lambda e: e.event_type).select(
        lambda e: {"event_type": e.event_type, "p90": r(e.value.percentile(0.9)), "mid": r(e.value.median()), "low": r(e.value.percentile(0.25).filter(fragment("{} % 2 = 0", e.user_id)))}
    )


@registered("integer_aggregates", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS s, avg(p_size) AS a, min(p_type) AS low, max(p_type) AS high, count(p_size) AS n FROM part GROUP BY 1")
def _():
    return Part.group_by(lambda p: p.p_brand).select(lambda p: {"p_brand": p.p_brand, "s": p.p_size.sum(), "a": p.p_size.avg(), "low": p.p_type.min(), "high": p.p_type.max(), "n": p.p_size.count()})


@registered("nothing_aggregated", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, max(p_name) AS m FROM part WHERE p_size < 0")
def _():
    return Part.where(lambda p: p.p_size < 0).select(n=count_rows(), s=lambda p: p.p_size.sum(), m=lambda p: p.p_name.max())


@registered("expression_aggregates", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, max(l_quantity * 2) AS m FROM lineitem GROUP BY 1")
def _():
    return Lineitem.group_by(lambda x: x.l_returnflag).select(lambda x: {"l_returnflag": x.l_returnflag, "revenue": total(x.l_extendedprice * (literal(1.0) - x.l_discount), 4), "m": (x.l_quantity * 2.0).max()})


@registered("decimal_aggregates", "SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS s, max(CAST(c_acctbal AS DECIMAL(18,2))) AS m FROM customer GROUP BY 1")
def _():
    exact = lambda c: c.c_acctbal.cast(T.DecimalType(18, 2))
    return Customer.group_by(lambda c: c.c_mktsegment).select(lambda c: {"c_mktsegment": c.c_mktsegment, "s": exact(c).sum(), "m": exact(c).max()})


@registered("count_of_groups", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 10)")
def _():
    from ..operators.repo import Repo

    q = Orders.group_by(lambda o: o.o_custkey).having(lambda o: count_rows() > 10).select(k=lambda o: o.o_custkey).order_by(lambda o: o.o_custkey).limit(3)
    return lambda c: Repo(c.catalog)._unsliced(q).agg(F.count(F.lit(1)).alias("n"))


@registered("distinct_rows", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders ORDER BY 1 DESC, 2")
def _():
    return Orders.select(lambda o: {"s": o.o_orderstatus, "p": o.o_orderpriority}).distinct().order_by(lambda o: (o.o_orderstatus.desc(), o.o_orderpriority))


@registered("distinct_on_latest", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def _():
    return Orders.query().distinct_on(lambda o: o.o_custkey).order_by(lambda o: (o.o_custkey, o.o_orderdate.desc(), o.o_orderkey)).select(lambda o: {"o_custkey": o.o_custkey, "o_orderkey": o.o_orderkey, "o_orderdate": o.o_orderdate})


@registered(
    "day_trend",
    "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS bought, round(median(value), 6) AS mid FROM events GROUP BY 1 ORDER BY n DESC, day",
)
def _():
    day = lambda e: e.ts.truncated("day")
    q = Event.group_by(day).select(lambda e: {"day": day(e), "n": count_rows(), "bought": count_rows().filter(e.event_type == "purchase"), "mid": fragment("round({}, 6)", e.value.median())})
    return q.order_by(lambda e: (count_rows().desc(), day(e)))


@registered("week_trend", "SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS week, date_trunc('year', o_orderdate)::TIMESTAMP AS year, count(*) AS n FROM orders GROUP BY 1, 2")
def _():
    w, y = (lambda o: o.o_orderdate.truncated("week")), (lambda o: o.o_orderdate.truncated("year"))
    return Orders.group_by(w, y).select(week=w, year=y, n=count_rows())


@registered("interval_seconds", "SELECT l_returnflag, round(avg(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6, 3) AS secs, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE epoch(l_shipdate) - epoch(o_orderdate) > 86400 GROUP BY 1")
def _():
    secs = lambda x, o: x.l_shipdate.interval_since(o.o_orderdate).seconds()
    q = Lineitem.join(Orders, lambda x, o: o.o_orderkey == x.l_orderkey).where(lambda x, o: secs(x, o) > 86400.0).group_by(lambda x, o: x.l_returnflag)
    return q.select(lambda x, o: {"l_returnflag": x.l_returnflag, "secs": fragment("round({}, 3)", secs(x, o).avg()), "n": count_rows()})


# filters


@registered("filter_compound", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 200000 AND (o_orderstatus = 'F' OR NOT (o_orderpriority <> '1-URGENT'))")
def _():
    q = Orders.where(lambda o: (o.o_totalprice >= 50000.0) & (o.o_totalprice < 200000.0)).where(lambda o: (o.o_orderstatus == "F") | ~(o.o_orderpriority != "1-URGENT"))
    return q.select(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice})


@registered("or_where", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR o_orderkey < 20")
def _():
    return Orders.where(lambda o: o.o_orderstatus == "F").where(lambda o: o.o_totalprice > 300000.0).or_where(lambda o: o.o_orderkey < 20).select(o_orderkey=lambda o: o.o_orderkey)


@registered("null_comparisons", f"SELECT o_orderkey, priority IS NULL AS missing, priority IS DISTINCT FROM '1-URGENT' AS other FROM {FILED} WHERE priority <> '2-HIGH' OR priority IS NULL")
def _():
    q = FiledOrder.with_deleted().where(lambda o: (o.priority != "2-HIGH") | (o.priority == None))  # noqa: E711
    return q.select(lambda o: {"o_orderkey": o.o_orderkey, "missing": o.priority.is_null(), "other": o.priority.is_distinct_from("1-URGENT")})


@registered("is_distinct_from", f"SELECT o_orderkey FROM {FILED} WHERE priority IS DISTINCT FROM '2-HIGH'")
def _():
    return FiledOrder.with_deleted().where(lambda o: o.priority.is_distinct_from("2-HIGH")).select(o_orderkey=lambda o: o.o_orderkey)


@registered("is_not_distinct_from", f"SELECT a.o_orderkey FROM {FILED} a JOIN {FILED} b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.priority IS NOT DISTINCT FROM b.priority")
def _():
    q = FiledOrder.query("a").with_deleted().join(FiledOrder.query("b"), lambda a, b: (a.o_custkey == b.o_custkey) & (a.o_orderkey < b.o_orderkey))
    return q.where(lambda a, b: a.priority.is_not_distinct_from(b.priority)).select(o_orderkey=lambda a, b: a.o_orderkey)


@registered("nullable_not_equal", f"SELECT o_orderkey FROM {FILED} WHERE priority <> '1-URGENT'")
def _():
    return FiledOrder.with_deleted().where(lambda o: o.priority != "1-URGENT").select(o_orderkey=lambda o: o.o_orderkey)


@registered("columns_compared", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate FROM lineitem WHERE l_discount > l_tax AND l_quantity <> l_linenumber AND l_partkey >= l_suppkey")
def _():
    q = Lineitem.where(lambda x: (x.l_discount > x.l_tax) & (x.l_quantity != x.l_linenumber) & (x.l_partkey >= x.l_suppkey))
    return q.select(lambda x: {n: getattr(x, n) for n in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")})


@registered("in_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 5, 9, 77, 400) OR o_orderstatus IN ('P')")
def _():
    return Orders.where(lambda o: o.o_custkey.in_([1, 5, 9, 77, 400]) | o.o_orderstatus.in_(["P"])).select(o_orderkey=lambda o: o.o_orderkey)


@registered("in_list_empty", f"SELECT o_orderkey, false AS held FROM {FILED} WHERE NOT false")
def _():
    return FiledOrder.with_deleted().where(lambda o: o.priority.not_in([])).select(lambda o: {"o_orderkey": o.o_orderkey, "held": o.priority.in_([])})


@registered("in_long_list", f"SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT unnest(range(0, 3000, 2)))")
def _():
    return Orders.where(lambda o: o.o_custkey.in_(list(range(0, 3000, 2)))).select(o_orderkey=lambda o: o.o_orderkey)


@registered("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _():
    big = Orders.where(lambda o: o.o_totalprice > 400000.0).select(k=lambda o: o.o_custkey)
    return Customer.where(lambda c: c.c_custkey.in_(big)).select(c_custkey=lambda c: c.c_custkey)


@registered("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def _():
    big = Orders.where(lambda o: o.o_totalprice > 100000.0).select(k=lambda o: o.o_custkey)
    return Customer.where(lambda c: c.c_custkey.not_in(big)).select(c_custkey=lambda c: c.c_custkey)


@registered("not_in_with_null", f"SELECT o_orderkey FROM {FILED} WHERE priority NOT IN (SELECT priority FROM {FILED})")
def _():
    held = FiledOrder.query("held").with_deleted().select(p=lambda o: o.priority)
    return FiledOrder.with_deleted().where(lambda o: o.priority.not_in(held)).select(o_orderkey=lambda o: o.o_orderkey)


@registered("like_ilike", r"SELECT p_partkey FROM part WHERE p_name LIKE '%a_%' ESCAPE '\' AND p_type ILIKE '%STEEL%' OR p_brand LIKE 'Brand#1%'")
def _():
    return Part.where(lambda p: p.p_name.like(r"%\a_%") & p.p_type.ilike("%STEEL%") | p.p_brand.like("Brand#1%")).select(p_partkey=lambda p: p.p_partkey)


@registered("contains_prefix_suffix", "SELECT c_custkey, contains(c_name, '00') AS a, starts_with(c_name, 'Cust') AS b, ends_with(c_name, '7') AS c, c_mktsegment ILIKE '%BUILD%' AS d, contains(c_name, '_') AS e FROM customer")
def _():
    return Customer.select(
        lambda c: {"c_custkey": c.c_custkey, "a": c.c_name.contains("00"), "b": c.c_name.has_prefix("Cust"), "c": c.c_name.has_suffix("7"), "d": c.c_mktsegment.contains("BUILD", any_case=True), "e": c.c_name.contains("_")}
    )


@registered("exists_correlated", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)")
def _():
    return Orders.where(lambda o: Lineitem.where(lambda x: (x.l_orderkey == o.o_orderkey) & (x.l_quantity > 49.0)).exists()).select(o_orderkey=lambda o: o.o_orderkey)


@registered("not_exists", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def _():
    return Orders.where(lambda o: Lineitem.where(lambda x: x.l_orderkey == o.o_orderkey).not_exists()).select(o_orderkey=lambda o: o.o_orderkey)


@registered("exists_or", "SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount > 0.09)")
def _():
    return Orders.where(lambda o: (o.o_orderstatus == "P") | Lineitem.where(lambda x: (x.l_orderkey == o.o_orderkey) & (x.l_discount > 0.09)).exists()).select(o_orderkey=lambda o: o.o_orderkey)


@registered("dynamic_filter", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")
def _():
    return Orders.filtered({"o_orderstatus": "O", "o_custkey": 7}).select(o_orderkey=lambda o: o.o_orderkey)


@registered("fragment_predicate", "SELECT o_orderkey, upper(o_orderpriority) || '!' AS p FROM orders WHERE length(o_orderpriority) > 6 AND o_orderkey % 3 = 1")
def _():
    q = Orders.where(lambda o: fragment("length({}) > {} AND {} % {} = 1", o.o_orderpriority, 6, o.o_orderkey, 3))
    return q.select(lambda o: {"o_orderkey": o.o_orderkey, "p": fragment("upper({}) || {}", o.o_orderpriority, "!")})


# joins


@registered("inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000")
def _():
    return Orders.join(Customer, lambda o, c: c.c_custkey == o.o_custkey).where(lambda o, c: c.c_acctbal > 5000.0).select(lambda o, c: {"o_orderkey": o.o_orderkey, "c_name": c.c_name})


@registered("left_join_zero_counts", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _():
    return Orders.left_join(Lineitem, lambda o, x: x.l_orderkey == o.o_orderkey).group_by(lambda o, x: o.o_orderkey).select(lambda o, x: {"o_orderkey": o.o_orderkey, "n": x.l_orderkey.count()})


@registered("grouped_then_joined", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def _():
    q = Orders.query().select(n=count_rows()).join(Customer, lambda o, c: c.c_custkey == o.o_custkey)
    return q.group_by(lambda o, c: c.c_mktsegment).select(lambda o, c: {"c_mktsegment": c.c_mktsegment, "n": count_rows()})


@registered("three_table_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1")
def _():
    q = Orders.join(Customer, lambda o, c: c.c_custkey == o.o_custkey).left_join(Nation, lambda o, c, n: (n.n_nationkey == c.c_nationkey) & (n.n_regionkey == 1))
    return q.select(lambda o, c, n: {"o_orderkey": o.o_orderkey, "c_name": c.c_name, "n_name": n.n_name})


@registered(
    "five_table_join",
    """SELECT r_name, s_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'O' GROUP BY 1, 2""",
)
def _():
    q = Lineitem.join(Orders, lambda x, o: o.o_orderkey == x.l_orderkey).join(Supplier, lambda x, o, s: s.s_suppkey == x.l_suppkey)
    q = q.join(Nation, lambda x, o, s, n: n.n_nationkey == s.s_nationkey).join(Region, lambda x, o, s, n, r: r.r_regionkey == n.n_regionkey)
    q = q.where(lambda x, o, *_: o.o_orderstatus == "O").group_by(lambda x, o, s, n, r: (r.r_name, s.s_name))
    return q.select(lambda x, o, s, n, r: {"r_name": r.r_name, "s_name": s.s_name, "n": count_rows(), "total": total(x.l_extendedprice)})


@registered("self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _():
    q = Nation.query("a").join(Nation.query("b"), lambda a, b: (a.n_regionkey == b.n_regionkey) & (a.n_nationkey < b.n_nationkey))
    return q.select(lambda a, b: {"a": a.n_name, "b": b.n_name})


@registered("theta_join", "SELECT s_suppkey, count(*) AS n FROM supplier JOIN nation ON s_acctbal > n_nationkey * 300 AND s_nationkey >= n_nationkey GROUP BY 1")
def _():
    q = Supplier.join(Nation, lambda s, n: (s.s_acctbal > n.n_nationkey * 300) & (s.s_nationkey >= n.n_nationkey))
    return q.group_by(lambda s, n: s.s_suppkey).select(lambda s, n: {"s_suppkey": s.s_suppkey, "n": count_rows()})


@registered("join_fan_out", "SELECT o.* FROM orders o JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 48")
def _():
    return Orders.join(Lineitem, lambda o, x: x.l_orderkey == o.o_orderkey).where(lambda o, x: x.l_quantity > 48.0)


@registered("join_distinct_base", "SELECT DISTINCT o.* FROM orders o JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 48")
def _():
    return Orders.join(Lineitem, lambda o, x: x.l_orderkey == o.o_orderkey).where(lambda o, x: x.l_quantity > 48.0).distinct()


# soft deletion


@registered("soft_delete_base", f"SELECT o_orderkey, o_totalprice FROM {FILED} WHERE deleted_at IS NULL AND o_totalprice > 100000")
def _():
    return FiledOrder.where(lambda o: o.o_totalprice > 100000.0).select(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice})


@registered("only_deleted", f"SELECT o_orderkey, deleted_at FROM {FILED} WHERE deleted_at IS NOT NULL")
def _():
    return FiledOrder.only_deleted().select(lambda o: {"o_orderkey": o.o_orderkey, "deleted_at": o.deleted_at})


@registered("soft_delete_left_join", f"SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN {FILED} f ON o_custkey = c_custkey AND deleted_at IS NULL GROUP BY 1")
def _():
    return Customer.left_join(FiledOrder, lambda c, o: o.o_custkey == c.c_custkey).group_by(lambda c, o: c.c_custkey).select(lambda c, o: {"c_custkey": c.c_custkey, "n": o.o_orderkey.count()})


@registered("soft_delete_lifted_join", f"SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN {FILED} f ON o_custkey = c_custkey GROUP BY 1")
def _():
    q = Customer.with_deleted().left_join(FiledOrder, lambda c, o: o.o_custkey == c.c_custkey)
    return q.group_by(lambda c, o: c.c_custkey).select(lambda c, o: {"c_custkey": c.c_custkey, "n": o.o_orderkey.count()})


# windows

PER_CUSTOMER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def by_date(o):
    return Window().partition_by(o.o_custkey).order_by(o.o_orderdate, o.o_orderkey)


@registered(
    "rank_family",
    "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS n, CAST(rank() OVER v AS INT) AS r, CAST(dense_rank() OVER v AS INT) AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority DESC NULLS FIRST)",
)
def _():
    v = lambda o: Window().partition_by(o.o_custkey).order_by(o.o_orderpriority.desc())
    return Orders.select(lambda o: {"o_orderkey": o.o_orderkey, "n": row_number().over(by_date(o)), "r": rank().over(v(o)), "d": dense_rank().over(v(o))})


@registered("running_sum", f"SELECT o_orderkey, round(sum(o_totalprice) {PER_CUSTOMER}), 2) AS total FROM orders")
def _():
    return Orders.select(lambda o: {"o_orderkey": o.o_orderkey, "total": o.o_totalprice.sum().over(by_date(o)).rounded(2)})


@registered("trailing_average", f"SELECT o_orderkey, round(avg(o_totalprice) {PER_CUSTOMER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS a, count(*) {PER_CUSTOMER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM orders")
def _():
    return Orders.select(
        lambda o: {"o_orderkey": o.o_orderkey, "a": (o.o_totalprice.avg().over(by_date(o).rows(-2, 0))).rounded(4), "later": count_rows().over(by_date(o).rows(1, "unbounded_following"))}
    )




@registered("range_frame", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM events")
def _():
    return Event.select(lambda e: {"event_id": e.event_id, "n": count_rows().over(Window().partition_by(e.event_type).order_by(e.user_id).range(-5, 5))})


@registered("lag_lead", f"SELECT o_orderkey, lag(o_orderkey) {PER_CUSTOMER}) AS before, lead(o_totalprice, 2) {PER_CUSTOMER}) AS after FROM orders")
def _():
    return Orders.select(lambda o: {"o_orderkey": o.o_orderkey, "before": lag(o.o_orderkey).over(by_date(o)), "after": lead(o.o_totalprice, 2).over(by_date(o))})


@registered("total_over", "SELECT n_nationkey, count(*) OVER () AS n, max(n_name) OVER (PARTITION BY n_regionkey) AS last FROM nation")
def _():
    return Nation.select(lambda n: {"n_nationkey": n.n_nationkey, "n": count_rows().over(), "last": n.n_name.max().over(Window().partition_by(n.n_regionkey))})


@registered("filtered_window", f"SELECT o_orderkey, count(*) FILTER (o_orderstatus = 'F') {PER_CUSTOMER}) AS f FROM orders")
def _():
    return Orders.select(lambda o: {"o_orderkey": o.o_orderkey, "f": count_rows().filter(o.o_orderstatus == "F").over(by_date(o))})


@registered("rank_by_aggregate", "SELECT o_custkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS INT) AS r FROM orders GROUP BY 1")
def _():
    return Orders.group_by(lambda o: o.o_custkey).select(lambda o: {"o_custkey": o.o_custkey, "n": count_rows(), "r": rank().over(Window().order_by(count_rows().desc()))})


# order and slices


@registered("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _():
    return Orders.query().order_by(lambda o: (o.o_totalprice.desc(), o.o_orderkey)).limit(25).select(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice})


@registered("nulls_ordering", f"(SELECT 'd' AS t, o_orderkey, priority FROM {FILED} ORDER BY priority DESC NULLS FIRST, o_orderkey LIMIT 40 OFFSET 5) UNION ALL (SELECT 'a', o_orderkey, priority FROM {FILED} ORDER BY priority ASC NULLS LAST, o_orderkey DESC NULLS FIRST LIMIT 40) UNION ALL (SELECT 'x', o_orderkey, priority FROM {FILED} ORDER BY priority ASC NULLS FIRST, o_orderkey LIMIT 9)")
def _():
    def part(tag, order, n, skip=0):
        return FiledOrder.with_deleted().order_by(order).limit(n).offset(skip).select(lambda o: {"t": literal(tag), "o_orderkey": o.o_orderkey, "priority": o.priority})

    d = part("d", lambda o: (o.priority.desc(), o.o_orderkey), 40, 5)
    a = part("a", lambda o: (o.priority.asc(), o.o_orderkey.desc()), 40)
    return combine("union_all", combine("union_all", d, a), part("x", lambda o: (o.priority.nulls_first(), o.o_orderkey), 9))


@registered("page_slice", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def _():
    def run(c):
        from ..operators.repo import PageRequest, Repo

        q = Orders.where(lambda o: o.o_orderstatus == "O")
        page = Repo(c.catalog).page(q, PageRequest(3, 20))
        return c.spark.createDataFrame([(r.o_orderkey, page.total) for r in page.items], "o_orderkey long, total long")

    return run


# sets


@registered("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _():
    return combine("union", Customer.select(k=lambda c: c.c_nationkey), Supplier.select(k=lambda s: s.s_nationkey))


@registered("union_then_filter", "SELECT * FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' UNION SELECT * FROM orders WHERE o_orderstatus = 'P') WHERE o_totalprice > 250000 ORDER BY o_orderkey LIMIT 50")
def _():
    q = Orders.where(lambda o: o.o_orderstatus == "F").union(Orders.where(lambda o: o.o_orderstatus == "P"))
    return q.where(lambda o: o.o_totalprice > 250000.0).order_by(lambda o: o.o_orderkey).limit(50)


@registered("bounded_branches", "(SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)")
def _():
    top, low = Orders.query().order_by(lambda o: (o.o_totalprice.desc(), o.o_orderkey)).limit(5), Orders.query().order_by(lambda o: (o.o_totalprice, o.o_orderkey)).limit(5)
    return combine("union_all", top.select(o_orderkey=lambda o: o.o_orderkey), low.select(o_orderkey=lambda o: o.o_orderkey))


@registered("feed_combined", "SELECT * FROM (SELECT o_orderkey AS id, 'order' AS kind FROM orders UNION ALL SELECT event_id, 'event' FROM events) ORDER BY id, kind LIMIT 30 OFFSET 10")
def _():
    a, b = Orders.select(id=lambda o: o.o_orderkey, kind=literal("order")), Event.select(kind=literal("event"), id=lambda e: e.event_id)
    return combine("union_all", a, b).order_by("id").order_by("kind").limit(30).offset(10)


@registered("union_all_whole", "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'")
def _():
    return Orders.query().union_all(Orders.where(lambda o: o.o_orderstatus == "F"))


@registered("intersect_whole", "SELECT * FROM orders INTERSECT SELECT * FROM orders WHERE o_orderstatus = 'F'")
def _():
    return Orders.query().intersect(Orders.where(lambda o: o.o_orderstatus == "F"))


@registered("except_whole", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _():
    return combine("except", Orders.select(k=lambda o: o.o_custkey), Customer.where(lambda c: c.c_acctbal > 0.0).select(k=lambda c: c.c_custkey))


@registered("union_then_filter_whole", "SELECT * FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' UNION SELECT * FROM orders WHERE o_orderstatus = 'P') WHERE o_totalprice > 250000")
def _():
    q = Orders.where(lambda o: o.o_orderstatus == "F").union(Orders.where(lambda o: o.o_orderstatus == "P"))
    return q.where(lambda o: o.o_totalprice > 250000.0)


@registered("union_intersect_left_whole", "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def _():
    a, b = Customer.select(k=lambda c: c.c_nationkey), Supplier.select(k=lambda s: s.s_nationkey)
    return combine("union", a, b).intersect(Nation.where(lambda n: n.n_regionkey == 1).select(k=lambda n: n.n_nationkey))


@registered("cte_reading_from_whole", "WITH recent AS (SELECT * FROM orders WHERE o_orderstatus <> 'P') SELECT o_orderstatus, count(*) AS n FROM recent GROUP BY 1")
def _():
    recent = Orders.where(lambda o: o.o_orderstatus != "P").cte("recent")
    return Orders.query().reading_from(recent).group_by(lambda o: o.o_orderstatus).select(lambda o: {"o_orderstatus": o.o_orderstatus, "n": count_rows()})


# subqueries and common tables


@registered("scalar_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS n FROM customer")
def _():
    return Customer.select(lambda c: {"c_custkey": c.c_custkey, "n": scalar_count(Orders.where(lambda o: (o.o_custkey == c.c_custkey) & (o.o_orderstatus == "P")))})


@registered(
    "scalar_count_of_groups",
    """SELECT c_custkey, (SELECT count(*) FROM (SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey GROUP BY 1)) AS g,
    (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)) AS d FROM customer""",
)
def _():
    own = lambda c: Orders.where(lambda o: o.o_custkey == c.c_custkey)
    groups = lambda c: own(c).group_by(lambda o: o.o_orderstatus).select(s=lambda o: o.o_orderstatus, n=count_rows())
    pairs = lambda c: own(c).where(lambda o: o.o_totalprice > 100000.0).select(s=lambda o: o.o_orderstatus, p=lambda o: o.o_orderpriority).distinct()
    return Customer.select(lambda c: {"c_custkey": c.c_custkey, "g": scalar_count(groups(c)), "d": scalar_count(pairs(c))})


@registered("scalar_lookup","SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 3) AS nation FROM customer")
def _():
    return Customer.select(lambda c: {"c_custkey": c.c_custkey, "nation": scalar(Nation.where(lambda n: (n.n_nationkey == c.c_nationkey) & (n.n_regionkey < 3)).select(n=lambda n: n.n_name))})


@registered("scalar_first", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer")
def _():
    best = lambda c: Orders.where(lambda o: o.o_custkey == c.c_custkey).order_by(lambda o: (o.o_totalprice.desc(), o.o_orderkey)).select(k=lambda o: o.o_orderkey)
    return Customer.select(lambda c: {"c_custkey": c.c_custkey, "best": scalar_first(best(c))})


@registered("scalar_in_where", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) * 2 FROM orders i WHERE i.o_custkey = o.o_custkey)")
def _():
    inner = lambda o: Orders.query("i").where(lambda i: i.o_custkey == o.o_custkey).select(a=lambda i: i.o_totalprice.avg() * 2.0)
    return Orders.where(lambda o: o.o_totalprice > scalar(inner(o))).select(o_orderkey=lambda o: o.o_orderkey)


@registered("cte_membership", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 350000) SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM big) AND NOT EXISTS (SELECT 1 FROM big WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _():
    big = Orders.where(lambda o: o.o_totalprice > 350000.0).cte("big")
    q = Customer.query().with_table(big).where(lambda c: c.c_custkey.in_(big.query().select(k=lambda b: b.o_custkey)))
    q = q.where(lambda c: big.query().where(lambda b: (b.o_custkey == c.c_custkey) & (b.o_orderstatus == "P")).not_exists())
    return q.select(lambda c: {"c_custkey": c.c_custkey, "c_name": c.c_name})


@registered("cte_join", "WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, n FROM customer LEFT JOIN t ON k = c_custkey AND n > 10")
def _():
    t = Orders.group_by(lambda o: o.o_custkey).select(lambda o: {"k": o.o_custkey, "n": count_rows()}).cte("t")
    return Customer.left_join(t, lambda c, t: (t.k == c.c_custkey) & (t.n > 10)).select(lambda c, t: {"c_custkey": c.c_custkey, "n": t.n})


@registered("recursive_tree", f"WITH RECURSIVE n AS (SELECT * FROM {NODES}), t AS (SELECT id, size, 0 AS depth FROM n WHERE id = 3 UNION ALL SELECT n.id, n.size, depth + 1 FROM n JOIN t ON n.parent_id = t.id) SELECT id, size FROM t")
def _():
    anchor = Node.where(lambda n: n.id == 3).select(id=lambda n: n.id, size=lambda n: n.size)
    return Recursive("tree", anchor, Node, lambda n, t: n.parent_id == t.id).query()


@registered("raw_recursive_table", f"WITH RECURSIVE n AS (SELECT * FROM {NODES}), t AS (SELECT id, parent_id, size FROM n WHERE id = 5 UNION ALL SELECT n.id, n.parent_id, n.size FROM n JOIN t ON n.parent_id = t.id) SELECT id, size FROM t WHERE size > 10")
def _():
    text = "WITH RECURSIVE t AS (SELECT * FROM {nodes} WHERE id = :root UNION ALL SELECT n.* FROM {nodes} n JOIN t ON n.parent_id = t.id) SELECT * FROM t"
    below = Raw(text, Node, (Node,), (("root", 5),)).cte("below")
    return Node.query().reading_from(below).where(lambda n: n.size > 10).select(lambda n: {"id": n.id, "size": n.size})


CYCLE = "(VALUES ('root', 'c'), ('b', 'root'), ('c', 'b')) e(id, parent_id)"


@registered(
    "recursive_cycle_paths",
    f"WITH RECURSIVE w AS (SELECT id, [id] AS walk, false AS closed FROM {CYCLE} WHERE id = 'root' UNION ALL SELECT e.id, list_append(walk, e.id), list_contains(walk, e.id) FROM {CYCLE} JOIN w ON e.parent_id = w.id AND NOT closed) SELECT id, array_to_string(walk, '>') AS path, closed FROM w",
)
def _():
    anchor = Edge.where(lambda e: e.id == "root").select(id=lambda e: e.id)
    walk = Recursive("walk", anchor, Edge, lambda e, w: e.parent_id == w.id, key="id", closers=True)
    return walk.query().select(lambda w: {"id": w.id, "path": fragment("array_join({}, {})", w.walked_path, ">"), "closed": w.closes_cycle})


# arithmetic


@registered("arithmetic", "SELECT p_partkey, p_size + 3 AS a, p_size * p_size - 2 AS b, round(p_retailprice / 3.0, 6) AS c, p_retailprice - 0.5 AS d FROM part")
def _():
    return Part.select(lambda p: {"p_partkey": p.p_partkey, "a": p.p_size + 3, "b": p.p_size * p.p_size - 2, "c": (p.p_retailprice / 3.0).rounded(6), "d": p.p_retailprice - 0.5})


@registered("integer_division", "SELECT p_partkey, CAST(trunc((p_size - 25) / 7.0) AS INT) AS q, p_partkey // 7 AS k FROM part")
def _():
    return Part.select(lambda p: {"p_partkey": p.p_partkey, "q": (p.p_size - 25) / 7, "k": p.p_partkey / 7})


@registered("mixed_arithmetic", "SELECT p_partkey, p_size * CAST(0.5 AS DOUBLE) AS a, p_partkey + p_size AS b, p_size - p_retailprice AS c, CAST(trunc(p_size / 4.0) AS BIGINT) AS d, p_size / CAST(4 AS DOUBLE) AS e FROM part")
def _():
    return Part.select(lambda p: {"p_partkey": p.p_partkey, "a": p.p_size * 0.5, "b": p.p_partkey + p.p_size, "c": p.p_size - p.p_retailprice, "d": (p.p_size / 4).cast(T.LongType()), "e": p.p_size / 4.0})


# writes: the table as it is after the change


def changed(make):
    return lambda: lambda c: make(c, c.catalog.frame)[0]


@registered("bulk_update", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN c_acctbal * 2 + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
@changed
def _(c, rows):
    return updated(c, rows(Customer), Customer.where(lambda x: x.c_acctbal < 0.0), c_acctbal=lambda x: x.c_acctbal * 2.0 + 1.0, c_mktsegment="DEBT")


@registered("bulk_delete", "SELECT * FROM customer WHERE NOT (c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000))")
@changed
def _(c, rows):
    big = Orders.where(lambda o: o.o_totalprice > 300000.0).select(k=lambda o: o.o_custkey)
    return removed(c, rows(Customer), Customer.where(lambda x: (x.c_acctbal < 0.0) & x.c_custkey.in_(big)))


def incoming(rows):
    old, n = rows(Customer), 1 << 40
    some = old.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100).withColumn("c_name", F.lit("new"))
    return some.unionByName(old.where("c_custkey % 100 = 1").withColumn("c_custkey", F.col("c_custkey") + n))


BATCH = f"(SELECT c_custkey, 'new' AS c_name, c_nationkey, c_acctbal + 100 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + {1 << 40}, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 100 = 1)"


@registered(
    "upsert_do_update",
    f"SELECT coalesce(o.c_custkey, i.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL OR i.c_acctbal > 1000 THEN i.c_name ELSE o.c_name END AS c_name, coalesce(o.c_nationkey, i.c_nationkey) AS c_nationkey, CASE WHEN o.c_custkey IS NULL THEN i.c_acctbal WHEN i.c_acctbal > 1000 THEN o.c_acctbal + i.c_acctbal ELSE o.c_acctbal END AS c_acctbal, coalesce(o.c_mktsegment, i.c_mktsegment) AS c_mktsegment FROM customer o FULL JOIN {BATCH} i ON i.c_custkey = o.c_custkey",
)
@changed
def _(c, rows):
    how = OnConflict.do_update("c_custkey", set={"c_name": lambda e, i: i.c_name, "c_acctbal": lambda e, i: e.c_acctbal + i.c_acctbal}, update_where=lambda e, i: i.c_acctbal > 1000.0)
    return upserted(c, rows(Customer), Customer, incoming(rows), how)


@registered("upsert_do_nothing", f"SELECT * FROM customer UNION ALL SELECT * FROM {BATCH} WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
@changed
def _(c, rows):
    return upserted(c, rows(Customer), Customer, incoming(rows), OnConflict.do_nothing("c_custkey"))


NOTES = "(SELECT s_suppkey AS id, s_name AS name, CAST(s_acctbal < 0 AS BIGINT) AS version, CAST(s_nationkey % 2 AS BIGINT) AS other FROM supplier)"


def notes(rows):
    """(stored, incoming): a note of each supplier, and another of the same name."""
    name = F.col("s_name").alias("name")
    stored = rows(Supplier).select(F.col("s_suppkey").alias("id"), name, (F.col("s_acctbal") < 0).cast("long").alias("version"))
    return stored, rows(Supplier).select((F.col("s_suppkey") + (1 << 40)).alias("id"), name, (F.col("s_nationkey") % 2).cast("long").alias("version"))


@registered("upsert_partial_index", f"SELECT id, name, CASE WHEN version = 0 AND other = 0 THEN 5 ELSE version END AS version FROM {NOTES} UNION ALL SELECT id + {1 << 40}, name, other FROM {NOTES} WHERE NOT (version = 0 AND other = 0)")
@changed
def _(c, rows):
    """Only rows that the index holds, stored and incoming, can clash."""
    stored, batch = notes(rows)
    return upserted(c, stored, Note, batch, OnConflict.do_update("name", set={"version": lambda e, i: e.version + i.version + 5}, where=lambda n: n.version == 0))


@registered("upsert_by_constraint", f"SELECT id, name, version + other AS version FROM {NOTES}")
@changed
def _(c, rows):
    """The target is a named constraint."""
    stored, batch = notes(rows)
    return upserted(c, stored, Note, batch, OnConflict.do_update(constraint="notes_name", set={"version": lambda e, i: e.version + i.version}))


@registered("soft_delete_write", f"SELECT o_orderkey, o_custkey, o_totalprice, priority, CASE WHEN deleted_at IS NULL AND o_custkey < 100 THEN TIMESTAMP '2024-01-01' ELSE deleted_at END AS deleted_at FROM {FILED}")
@changed
def _(c, rows):
    import datetime as dt

    return soft_deleted(c, rows(FiledOrder), FiledOrder.where(lambda o: o.o_custkey < 100), dt.datetime(2024, 1, 1))


@registered("restore_write", f"SELECT o_orderkey, o_custkey, o_totalprice, priority, CASE WHEN o_custkey >= 100 THEN deleted_at END AS deleted_at FROM {FILED}")
@changed
def _(c, rows):
    return restored(c, rows(FiledOrder), FiledOrder.where(lambda o: o.o_custkey < 100))


# transactions over the store: the table as it stands after the commit


def stored(make):
    """A query that works on a new store, in the folder that spark.checkpoint.dir names, and gives what make gives."""
    return lambda: lambda c: make(c, Store(c.spark, f"{shared_folder(c.spark)}/relq-store-{uuid.uuid4().hex}"))


def filled(c, store, *entities):
    with transaction(store, list(entities)) as t:
        for e in entities:
            t.insert(e, c.catalog.frame(e))
    return store


def refused(run) -> bool:
    try:
        run()
    except RelqError:
        return True
    return False


@registered("insert_batch", "SELECT * FROM supplier UNION ALL VALUES (-1, 'one', 3, 0.5), (-2, 'two', 4, -1.5)")
@stored
def _(c, store):
    """A frame and a list, in two versions of which the second adds one folder."""
    filled(c, store, Supplier)
    with transaction(store, [Supplier]) as t:
        t.insert(Supplier, [{"s_suppkey": -1, "s_name": "one", "s_nationkey": 3, "s_acctbal": 0.5}, {"s_suppkey": -2, "s_name": "two", "s_nationkey": 4, "s_acctbal": -1.5}])
    return store.read(Supplier)


@registered("insert_existing_key_refused", "SELECT *, true AS refused FROM supplier")
@stored
def _(c, store):
    filled(c, store, Supplier)
    again = lambda: filled(c, store, Supplier)
    return store.read(Supplier).withColumn("refused", F.lit(refused(again)))


@registered("insert_generated_keys", "SELECT 25 + row_number() OVER (ORDER BY n_nationkey) AS id, n_name AS name, 0 AS version FROM nation UNION ALL SELECT n_nationkey, n_name, 0 FROM nation WHERE n_nationkey > 0 UNION ALL SELECT 25, 'given', 0")
@stored
def _(c, store):
    """D3: given numbers stay, and the rest is numbered after the largest, in the order of the list."""
    with transaction(store, [Note]) as t:
        t.insert(Note, c.catalog.frame(Nation).where("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(0).cast("long").alias("version")))
        t.insert(Note, [{"id": 25, "name": "given", "version": 0}])
        t.insert(Note, [{"name": r.n_name, "version": 0} for r in c.catalog.frame(Nation).orderBy("n_nationkey").collect()])  # 25 rows
    return store.read(Note)


@registered("update_row_with_version", "SELECT s_suppkey AS id, CASE WHEN s_suppkey IN (1, 2) THEN 'changed' ELSE s_name END AS name, CASE WHEN s_suppkey = 1 THEN 2 WHEN s_suppkey = 2 THEN 1 ELSE 0 END AS version, true AS stale_refused FROM supplier")
@stored
def _(c, store):
    """One row by key, only the named columns; the version goes up, and a row read before is refused."""
    with transaction(store, [Note]) as t:
        t.insert(Note, c.catalog.frame(Supplier).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(0).cast("long").alias("version")))
    with transaction(store, [Note]) as t:
        t.update_row(Note, {"id": 1, "version": 0}, name="first")
        t.update_row(Note, {"id": 1, "version": 1}, name="changed")
        t.update_row(Note, {"id": 2, "version": 0}, name="changed")
        stale = refused(lambda: t.update_row(Note, {"id": 2, "version": 0}, name="lost"))
    return store.read(Note).withColumn("stale_refused", F.lit(stale))


@registered("delete_row", "SELECT *, true AS missing_refused FROM supplier WHERE s_suppkey <> 3")
@stored
def _(c, store):
    """One row by key; no such row is an error."""
    filled(c, store, Supplier)
    with transaction(store, [Supplier]) as t:
        t.delete_row(Supplier, {"s_suppkey": 3})
        missing = refused(lambda: t.delete_row(Supplier, {"s_suppkey": 3}))
    return store.read(Supplier).withColumn("missing_refused", F.lit(missing))


@registered("transaction_rolls_back", "SELECT * FROM supplier")
@stored
def _(c, store):
    """What a failed block changed is not there, nor what it staged."""
    filled(c, store, Supplier)

    def fail():
        with transaction(store, [Supplier]) as t:
            t.delete(Supplier.where(lambda s: s.s_acctbal > 0.0))
            raise RelqError(None, "on purpose")

    refused(fail)
    return store.read(Supplier)


@registered("savepoint_rolls_back", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
@stored
def _(c, store):
    """The inner block goes, the outer one stays."""
    filled(c, store, Supplier)
    with transaction(store, [Supplier]) as t:
        t.update(Supplier.where(lambda s: s.s_acctbal < 0.0), s_acctbal=0.0)

        def fail():
            with t.savepoint():
                t.delete(Supplier.where(lambda s: s.s_nationkey > 0))
                raise RelqError(None, "on purpose")

        refused(fail)
    return store.read(Supplier)


@registered("locked_read_conflict", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey = 1 THEN 1 ELSE s_acctbal END AS s_acctbal, true AS refused FROM supplier")
@stored
def _(c, store):
    """A table that was read with a lock and changed by another makes the commit fail; a retry succeeds."""
    filled(c, store, Supplier)
    late = Session(store, [Supplier])
    late.all(Supplier.where(lambda s: s.s_suppkey == 1).lock_for_update())
    with_retries(store, [Supplier], lambda t: t.update(Supplier.where(lambda s: s.s_suppkey == 1), s_acctbal=1.0))
    return store.read(Supplier).withColumn("refused", F.lit(refused(late.commit)))


@registered("isolation_levels", "SELECT *, (SELECT count(*) FROM supplier) AS steady, (SELECT count(*) FROM supplier) - 1 AS fresh, true AS strict_refused FROM supplier WHERE s_suppkey <> 1")
@stored
def _(c, store):
    """What another commits between is seen by read_committed only, and makes a serializable writer fail."""
    filled(c, store, Supplier, Nation)
    steady, fresh, strict = (Session(store, [Supplier, Nation], isolation=x) for x in ("repeatable_read", "read_committed", "serializable"))
    with transaction(store, [Supplier]) as t:
        t.delete_row(Supplier, {"s_suppkey": 1})
    strict.delete(Nation.where(lambda n: n.n_nationkey == 0))
    seen = {"steady": steady.repo.count(Supplier.query()), "fresh": fresh.repo.count(Supplier.query())}
    rows = store.read(Supplier).withColumns({n: F.lit(v).cast("long") for n, v in seen.items()})
    return rows.withColumn("strict_refused", F.lit(refused(strict.commit)))


@registered("multi_steps","SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey = 5 THEN 7 ELSE s_acctbal END AS s_acctbal, 'broken' AS failed_step FROM supplier WHERE s_suppkey <> 4")
@stored
def _(c, store):
    """Named steps of one transaction; a failing step undoes all of its run and is named."""
    filled(c, store, Supplier)
    good = Multi().step("gone", lambda t, done: t.delete(Supplier.where(lambda s: s.s_suppkey == 4))).step("set", lambda t, done: t.update(Supplier.where(lambda s: s.s_suppkey == 4 + done["gone"]), s_acctbal=7.0))
    good.run(store, [Supplier])
    bad = Multi().step("all", lambda t, done: t.delete(all_rows(Supplier))).step("broken", lambda t, done: t.delete_row(Supplier, {"s_suppkey": 4}))
    return store.read(Supplier).withColumn("failed_step", F.lit(bad.run(store, [Supplier]).step))


@registered("pinned_version", "SELECT * FROM supplier")
@stored
def _(c, store):
    """A version that was read stays as it was."""
    filled(c, store, Supplier)
    with transaction(store, [Supplier]) as t:
        t.delete(Supplier.where(lambda s: s.s_acctbal > 0.0))
    return store.read(Supplier, 1)


# associations


@registered("preload_keeps_order", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS place, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS BIGINT) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40)")
def _():
    """L1: parents stand in their order after the associations were joined to them."""

    def run(c):
        from ..operators.repo import Repo

        rows = Repo(c.catalog).all(Customer.query().order_by(lambda x: (x.c_acctbal.desc(), x.c_custkey)).limit(40).preload("orders"))
        return c.spark.createDataFrame([(r.c_custkey, i + 1, len(r.orders)) for i, r in enumerate(rows)], "c_custkey long, place long, n long")

    return run


@registered("preload_has_many", "SELECT c_custkey, count(o_orderkey) AS n, min(o_orderkey) AS low, coalesce(sum(o_orderkey), 0)::BIGINT AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY 1")
def _():
    q = Customer.preload("orders", lambda o: o.where(lambda x: x.o_orderstatus != "P"))
    keys = F.transform("orders", lambda x: x["o_orderkey"])
    return lambda c: c.query(q).select("c_custkey", F.size("orders").cast("long").alias("n"), F.array_min(keys).alias("low"), F.aggregate(keys, F.lit(0).cast("long"), lambda a, b: a + b).alias("s"))


@registered("preload_has_one", "SELECT c_custkey, o_orderkey AS best FROM customer LEFT JOIN (SELECT DISTINCT ON (o_custkey) * FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey) ON o_custkey = c_custkey")
def _():
    q = Customer.preload("latest_order", lambda o: o.order_by(lambda x: x.o_totalprice.desc()))
    return lambda c: c.query(q).select("c_custkey", F.col("latest_order.o_orderkey").alias("best"))


@registered("preload_belongs_to", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def _():
    q = Orders.preload("customer", lambda c: c.preload("nation"))
    return lambda c: c.query(q).select("o_orderkey", F.col("customer.c_name").alias("c_name"), F.col("customer.nation.n_name").alias("n_name"))


@registered("preload_through", "SELECT o_orderkey, count(p_partkey) AS n, max(p_name) AS last FROM orders LEFT JOIN (lineitem JOIN part ON p_partkey = l_partkey AND p_size > 20) ON l_orderkey = o_orderkey GROUP BY 1")
def _():
    q = Orders.preload("parts", lambda p: p.where(lambda x: x.p_size > 20))
    return lambda c: c.query(q).select("o_orderkey", F.size("parts").cast("long").alias("n"), F.array_max(F.transform("parts", lambda x: x["p_name"])).alias("last"))


@registered("preload_nullable_parent", f"SELECT a.id, b.id AS parent, b.size FROM {NODES} a LEFT JOIN {NODES} b ON b.id = a.parent_id")
def _():
    """L4: a row without a parent has none."""
    q = Node.preload("parent")
    return lambda c: c.query(q).select("id", F.col("parent.id").alias("parent"), F.col("parent.size").alias("size"))


@registered("preload_nullable_children", f"SELECT a.id, count(b.id) AS n, coalesce(sum(b.size), 0)::BIGINT AS s FROM {NODES} a LEFT JOIN {NODES} b ON b.parent_id = a.id GROUP BY 1")
def _():
    """L2: rows whose key is null are nobody's children."""
    q = Node.preload("children")
    sizes = F.aggregate("children", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    return lambda c: c.query(q).select("id", F.size("children").cast("long").alias("n"), sizes.alias("s"))


@registered("preload_over_join", "SELECT o_orderkey, c_name, count(l_partkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal > 5000 GROUP BY 1, 2")
def _():
    """Associations of the base rows of a join."""
    q = Orders.join(Customer, lambda o, c: c.c_custkey == o.o_custkey).where(lambda o, c: c.c_acctbal > 5000.0).preload("customer").preload("parts")
    return lambda c: c.query(q).select("o_orderkey", F.col("customer.c_name").alias("c_name"), F.size("parts").cast("long").alias("n"))


# single answers


@registered("exists_one_count", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P') AS found, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS missed, (SELECT n_name FROM nation WHERE n_nationkey = 3) AS name, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS n, true AS several_refused")
def _():
    """A17, O5."""

    def run(c):
        from ..operators.repo import Repo

        repo = Repo(c.catalog)
        found, missed = repo.exists(Orders.where(lambda o: o.o_orderstatus == "P")), repo.exists(Orders.where(lambda o: o.o_totalprice < 0.0))
        name, n = repo.one(Nation.where(lambda x: x.n_nationkey == 3)).n_name, repo.count(Customer.where(lambda x: x.c_acctbal > 0.0))
        row = (found, missed, name, n, refused(lambda: repo.one(Nation.query())))
        return c.spark.createDataFrame([row], "found boolean, missed boolean, name string, n long, several_refused boolean")

    return run


# rows read lazily


@registered("streamed_rows", "SELECT o_orderkey FROM orders WHERE o_totalprice > 450000")
def _():
    def run(c):
        from ..operators.repo import Repo

        with Repo(c.catalog).stream(Orders.where(lambda o: o.o_totalprice > 450000.0).select(k=lambda o: o.o_orderkey)) as rows:
            return c.spark.createDataFrame([(r.k,) for r in rows], "o_orderkey long")

    return run


# single columns, lists, names and statements


@registered("boolean_column", f"SELECT s_suppkey FROM {DEBTORS} WHERE in_debt")
def _():
    """a boolean column is a predicate by itself; null is not true."""
    return Debtor.where(lambda d: d.in_debt).select(s_suppkey=lambda d: d.s_suppkey)


@registered("boolean_column_negated", f"SELECT s_suppkey FROM {DEBTORS} WHERE NOT in_debt AND s_suppkey > 1")
def _():
    return Debtor.where(lambda d: ~d.in_debt & (d.s_suppkey > 1)).select(s_suppkey=lambda d: d.s_suppkey)


class Status(enum.Enum):
    FINISHED, OPEN, PENDING = "F", "O", "P"


@registered("enum_list", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def _():
    """F12."""
    return Orders.where(lambda o: o.o_orderstatus.in_([Status.FINISHED, Status.PENDING])).group_by(lambda o: o.o_orderstatus).select(lambda o: {"o_orderstatus": o.o_orderstatus, "n": count_rows()})


@registered("enum_list_empty", "SELECT o_orderkey FROM orders WHERE false")
def _():
    return Orders.where(lambda o: o.o_orderstatus.in_([])).select(o_orderkey=lambda o: o.o_orderkey)


@registered("positional_projection", "SELECT c_custkey AS _1, c_name AS _2, c_acctbal AS _3 FROM customer")
def _():
    """P2."""
    return Customer.select(lambda c: (c.c_custkey, c.c_name, c.c_acctbal))


@registered("schema_qualified", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _():
    """A table of a named schema of Spark's catalog."""

    def run(c):
        c.catalog.frame(Nation).createOrReplaceGlobalTempView(HeldNation.__table__)
        return c.query(HeldNation.where(lambda n: n.n_regionkey == 2).select(lambda n: {"n_nationkey": n.n_nationkey, "n_name": n.n_name}))

    return run


@registered("raw_statement", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 4 GROUP BY 1")
def _():
    """Text with named values."""

    def run(c):
        from ..operators.repo import Repo

        c.catalog.frame(Nation).createOrReplaceGlobalTempView(HeldNation.__table__)
        return Repo(c.catalog).execute(f"SELECT n_regionkey, count(*) AS n FROM global_temp.{HeldNation.__table__} WHERE n_nationkey > :least GROUP BY 1", least=4)

    return run


@registered("unloaded_association", "SELECT c_custkey, true AS refused FROM customer ORDER BY c_custkey LIMIT 1")
def _():
    """An association that was not preloaded is an error, not an empty list."""

    def run(c):
        from ..operators.repo import Repo, loaded

        row = Repo(c.catalog).all(Customer.query().order_by(lambda x: x.c_custkey).limit(1))[0]
        return c.spark.createDataFrame([(row.c_custkey, refused(lambda: loaded(row, "orders")))], "c_custkey long, refused boolean")

    return run


@registered("common_table_in_write", "WITH big AS (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) SELECT * FROM customer WHERE NOT (c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM big))")
@changed
def _(c, rows):
    """A common table decides which rows a write touches."""
    big = Orders.where(lambda o: o.o_totalprice > 350000.0).cte("big")
    return removed(c, rows(Customer), Customer.query().with_table(big).where(lambda x: (x.c_acctbal < 0.0) & x.c_custkey.in_(big.query().select(k=lambda b: b.o_custkey))))


@registered("with_deleted_not_reapplied", f"SELECT o_orderkey FROM (SELECT * FROM {FILED} WHERE deleted_at IS NOT NULL UNION ALL SELECT * FROM {FILED} WHERE deleted_at IS NULL) WHERE o_totalprice > 200000")
def _():
    """The branches say which deleted rows there are, what is around them does not say it again."""
    return FiledOrder.only_deleted().union_all(FiledOrder.query()).where(lambda o: o.o_totalprice > 200000.0).select(o_orderkey=lambda o: o.o_orderkey)
