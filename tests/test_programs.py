"""Generated programs of query methods: Spark accepts each, and a plain model of the same steps gives the same rows."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from relq.errors import RelqError
from relq.operators.repo import Repo
from relq.operators.write import refuse_clauses, removed
from relq.plans.compiler import Compiler
from relq.sources import Catalog, Entity, Field

ROWS = [(i, i * 7 % 5, None if i % 4 == 0 else f"n{i % 3}", i % 2 == 0) for i in range(24)]


class Item(Entity, table="items"):
    id = Field("long", key=True)
    score = Field("long")
    name = Field("string", nullable=True)
    live = Field("boolean")


step = st.one_of(
    st.tuples(st.just("where"), st.integers(0, 4)),
    st.tuples(st.just("or_where"), st.integers(0, 23)),
    st.tuples(st.just("limit"), st.integers(0, 12)),
    st.tuples(st.just("offset"), st.integers(0, 6)),
    st.tuples(st.just("distinct"), st.just(0)),
    st.tuples(st.sampled_from(["union", "union_all", "intersect", "except_"]), st.integers(0, 23)),
    st.tuples(st.just("cte"), st.just(0)),
)


def model(program):
    """Rows by the meaning of the steps: conditions, then the slice, of each combination so far."""
    source, cond, limit, offset, distinct = list(ROWS), None, None, 0, False

    def rows():
        out = [r for r in source if cond is None or cond(r)]
        out = list(dict.fromkeys(out)) if distinct else out
        out = sorted(out)[offset:]
        return out if limit is None else out[:limit]

    for op, n in program:
        if op == "where":
            cond = (lambda r, n=n, c=cond: (c is None or c(r)) and r[1] >= n)
        elif op == "or_where":
            cond = (lambda r, n=n, c=cond: (c(r) if c else False) or r[0] == n) if cond else (lambda r, n=n: r[0] == n)
        elif op == "limit":
            limit = n
        elif op == "offset":
            offset = n
        elif op == "distinct":
            distinct = True
        else:
            now = rows()
            other = [r for r in ROWS if r[0] <= n]
            if op == "union":
                now = list(dict.fromkeys(now + other))
            elif op == "union_all":
                now = now + other
            elif op == "intersect":
                now = [r for r in dict.fromkeys(now) if r in other]
            elif op == "except_":
                now = [r for r in dict.fromkeys(now) if r not in other]
            source, cond, limit, offset, distinct = now, None, None, 0, False
    return sorted(rows())


def build(program):
    q, names = Item.query(), 0
    by_id = lambda q: q.order_by(lambda c: c.id) if not q.order else q
    for op, n in program:
        if op == "where":
            q = q.where(lambda c, n=n: c.score >= n)
        elif op == "or_where":
            q = q.or_where(lambda c, n=n: c.id == n)
        elif op in ("limit", "offset"):
            q = getattr(by_id(q), op)(n)
        elif op == "distinct":
            q = q.distinct()
        elif op == "cte":
            names += 1
            q = Item.query().reading_from(q.cte(f"t{names}"))
        else:
            q = getattr(q, op)(Item.where(lambda c, n=n: c.id <= n))
    return q


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(program=st.lists(step, max_size=6))
def test_programs_mean_what_they_say(spark, program):
    items = spark.createDataFrame(ROWS, "id long, score long, name string, live boolean")
    repo = Repo(Catalog(spark, None, {"items": items}))
    q = build(program)
    assert sorted(tuple(r) for r in repo.frame(q).collect()) == model(program)
    try:
        refuse_clauses(q)
    except RelqError as e:
        assert e.code == 4111
    else:
        left, hit = removed(Compiler(repo.catalog), items, q)
        assert hit.count() == len(model(program)) and left.count() == len(ROWS) - len(model(program))
