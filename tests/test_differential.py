"""Generated predicates on Spark against a plain three-valued evaluator."""

import operator

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from relq.operators.repo import Repo
from relq.sources import Catalog, Entity, Field

NAMES = [None, "alice", "bob", "carol"]
ROWS = [(i, t, v, NAMES[(i + v) % 4], v % 20 == 0) for i, (t, v) in enumerate((t, v) for t in ("first", "second", "third") for v in (0, 10, 50, 100))]
OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class Post(Entity, table="posts"):
    id = Field("long", key=True)
    title = Field("string")
    views = Field("long")
    nickname = Field("string", nullable=True)
    published = Field("boolean")


leaf = st.one_of(
    st.tuples(st.just("cmp"), st.just("views"), st.sampled_from(sorted(OPS)), st.sampled_from([0, 10, 50, 99])),
    st.tuples(st.just("cmp"), st.just("nickname"), st.sampled_from(["==", "!=", "<", ">="]), st.sampled_from(["alice", "bob", "zed"])),
    st.tuples(st.just("null"), st.just("nickname"), st.booleans()),
    st.tuples(st.just("distinct"), st.just("nickname"), st.sampled_from([None, "alice", "bob"])),
    st.tuples(st.just("in"), st.sampled_from(["nickname", "title"]), st.lists(st.sampled_from(["alice", "carol", "first"]), max_size=2)),
    st.tuples(st.just("like"), st.sampled_from(["nickname", "title"]), st.sampled_from(["a", "ir", "b"])),
    st.tuples(st.just("flag")),
)
tree = st.recursive(leaf, lambda t: st.one_of(st.tuples(st.just("not"), t), st.tuples(st.sampled_from(["and", "or"]), t, t)), max_leaves=8)


def build(c, t):
    kind = t[0]
    if kind == "cmp":
        return OPS[t[2]](getattr(c, t[1]), t[3])
    if kind == "null":
        return getattr(c, t[1]).is_null() if t[2] else getattr(c, t[1]) != None  # noqa: E711
    if kind == "distinct":
        return c.nickname.is_distinct_from(t[2])
    if kind == "in":
        return getattr(c, t[1]).in_(t[2])
    if kind == "like":
        return getattr(c, t[1]).contains(t[2])
    if kind == "flag":
        return c.published
    if kind == "not":
        return ~build(c, t[1])
    return build(c, t[1]) & build(c, t[2]) if kind == "and" else build(c, t[1]) | build(c, t[2])


def value(row, t):
    """True, False or None."""
    kind = t[0]
    if kind == "flag":
        return row["published"]
    if kind == "not":
        x = value(row, t[1])
        return None if x is None else not x
    if kind in ("and", "or"):
        x, y = value(row, t[1]), value(row, t[2])
        ends = kind == "or"
        return ends if ends in (x, y) else None if None in (x, y) else not ends
    v = row[t[1]]
    if kind == "null":
        return (v is None) == t[2]
    if kind == "distinct":
        return v != t[2]
    if kind == "in" and not t[2]:
        return False
    if v is None:
        return None
    return OPS[t[2]](v, t[3]) if kind == "cmp" else v in t[2] if kind == "in" else t[2] in v


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(trees=st.lists(tree, min_size=4, max_size=4))
def test_three_valued_logic(spark, trees):
    posts = spark.createDataFrame(ROWS, "id long, title string, views long, nickname string, published boolean")
    repo = Repo(Catalog(spark, None, {"posts": posts}))
    frames = [repo.frame(Post.where(lambda c, t=t: build(c, t)).select(id=lambda c: c.id)).selectExpr("id", f"{i} as k") for i, t in enumerate(trees)]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionAll(f)
    got = {tuple(r) for r in df.collect()}
    rows = [dict(zip(("id", "title", "views", "nickname", "published"), r)) for r in ROWS]
    assert got == {(r["id"], i) for i, t in enumerate(trees) for r in rows if value(r, t) is True}
