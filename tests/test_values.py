"""Query values: what is refused while they are built, and that they are immutable."""

import pytest

from relq.errors import InvalidConflictClause, InvalidProjection, RelqError, classify
from relq.functions import Window, fragment, lag, literal, row_number
from relq.functions.expr import following, preceding
from relq.operators import combine
from relq.operators.write import OnConflict, refuse_clauses
from relq.sources import Entity, Field
from relq.sources.star import Customer, FiledOrder, Nation, Note, Orders


def code(f):
    with pytest.raises(RelqError) as e:
        f()
    return e.value.code


def test_phase_rules():
    assert code(lambda: Orders.where(lambda o: o.o_totalprice.sum() > 1)) == 4001
    assert code(lambda: Orders.where(lambda o: row_number().over() == 1)) == 4002
    assert code(lambda: Orders.query().having(lambda o: o.o_totalprice.sum().over() > 1)) == 4002
    assert code(lambda: Orders.group_by(lambda o: o.o_totalprice.max())) == 4001
    assert code(lambda: Orders.group_by(lambda o: o.o_custkey).checked()) == 4004
    assert code(lambda: Orders.join(Nation, lambda o, n: o.o_custkey == n.n_nationkey).group_by(lambda o, n: o.o_custkey).checked()) == 4004


def test_frames():
    w = Window().order_by(Orders.o_orderkey)
    assert code(lambda: w.rows(2, 1)) == 4003
    assert code(lambda: w.rows("unbounded_following", 0)) == 4003
    assert code(lambda: w.rows(0, "unbounded_preceding")) == 4003
    assert code(lambda: preceding(-1)) == 4003 and code(lambda: following(-2)) == 4003
    assert code(lambda: w.order_by(Orders.o_custkey).range(-1, 1)) == 4003
    assert w.rows("unbounded_preceding", preceding(1)).frame == ("rows", None, -1)


def test_joins_need_names_of_their_own():
    assert code(lambda: Nation.join(Nation, lambda a, b: a.n_nationkey == b.n_nationkey)) == 4007
    assert Nation.query("a").join(Nation, lambda a, b: a.n_nationkey == b.n_nationkey).joins[0].alias == "nation"


def test_sets():
    q = Orders.where(lambda o: o.o_orderkey < 3)
    assert code(lambda: q.lock_for_update().union(q)) == 4005
    with pytest.raises(RelqError):
        q.lock_for_update("skip_locked")
    with pytest.raises(InvalidProjection):
        combine("union", Orders.select(a=lambda o: o.o_orderkey), Customer.select(b=lambda c: c.c_custkey))
    with pytest.raises(InvalidProjection):
        combine("union", Orders.select(a=lambda o: o.o_orderkey), Customer.select(a=lambda c: c.c_custkey)).order_by("z")


def test_distinct_rules():
    with pytest.raises(InvalidProjection):
        Orders.select(a=lambda o: o.o_custkey).distinct().order_by(lambda o: o.o_orderkey).checked()
    with pytest.raises(InvalidProjection):
        Orders.query().distinct_on(lambda o: o.o_custkey).order_by(lambda o: o.o_orderkey).checked()


def test_projections():
    with pytest.raises(InvalidProjection):
        Orders.select()
    with pytest.raises(InvalidProjection):
        Orders.select(a=lambda o: o.o_orderkey.desc())
    assert [n for n, _ in Orders.select(lambda o: (o.o_orderkey, o.o_custkey)).selection] == ["_1", "_2"]


def test_dynamic_filters():
    assert code(lambda: Orders.filtered({"o_orderdate": "2024-01-01"})) == 4112
    assert code(lambda: Orders.filtered({"nothing": 1})) == 4112
    assert code(lambda: Orders.filtered({"o_custkey": "7"})) == 4113
    assert code(lambda: Orders.filtered({"o_custkey": True})) == 4113
    assert code(lambda: Orders.filtered({"o_custkey": 1 << 63})) == 4113
    assert code(lambda: Orders.filtered({"o_orderstatus": "X"})) == 4113
    assert Orders.filtered({"o_totalprice": 3}).condition.args[2].args == (3.0,)
    assert Orders.filtered({"o_orderpriority": None}).condition.op == "is_null"

    class Small(Entity, table="small", filterable=("n", "tags")):
        n = Field("short")
        tags = Field("array<string>")

    assert code(lambda: Small.filtered({"n": 70000})) == 4113
    assert code(lambda: Small.filtered({"tags": "a"})) == 4006


def test_bulk_writes_refuse_clauses():
    for q in (Orders.limit(1), Orders.query().offset(2), Orders.order_by(lambda o: o.o_orderkey), Orders.distinct(), Orders.select(a=lambda o: o.o_orderkey), Orders.query().lock_for_update(), Orders.query().reading_from(Orders.query().cte("c"))):
        assert code(lambda q=q: refuse_clauses(q)) == 4111
    with pytest.raises(InvalidConflictClause):
        OnConflict.do_update("a", set=())
    with pytest.raises(InvalidConflictClause):
        OnConflict.do_update("name", set=("version",), constraint="notes_name")
    with pytest.raises(InvalidConflictClause):
        OnConflict.do_nothing(constraint="notes_id").columns(Note)
    assert OnConflict.do_nothing(constraint="notes_name").columns(Note) == ["name"] and OnConflict.do_nothing().columns(Note) == ["id"]


def test_values_do_not_change():
    q = Orders.where(lambda o: o.o_orderkey < 3)
    q.where(lambda o: o.o_custkey == 1).limit(4).distinct()
    assert q.limit_ is None and q.condition.op == "compare" and q.distinct_ is False
    with pytest.raises(AttributeError):
        q.condition.op = "x"
    with pytest.raises(TypeError):
        Orders.where(lambda o: o.o_orderkey < 3 and o.o_custkey > 1)


def test_names_and_definitions():
    a, b = Orders.limit(1).cte("t"), Orders.limit(2).cte("t")
    with pytest.raises(RelqError):
        Orders.query().with_table(a).with_table(b)
    assert len(Orders.query().with_table(a).with_table(a).ctes) == 1
    with pytest.raises(RelqError):
        Customer.preload("nothing")
    assert code(lambda: Orders.only_deleted()) == 4105
    assert FiledOrder.only_deleted().scope == "only"
    with pytest.raises(ValueError):
        fragment("{} > {}", 1)
    with pytest.raises(ValueError):
        literal(1).percentile(1.5)
    assert lag(Orders.o_orderkey).type.simpleString() == "bigint"
    assert classify(ZeroDivisionError()) == "other"
