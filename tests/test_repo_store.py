"""Running queries, and writing through transactions."""

import datetime as dt
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from relq.errors import RelqError, StatementTimeout, VersionConflict, classify
from relq.functions import fragment, now, scalar
from relq.operators.repo import Diagnostics, PageRequest, Repo, loaded
from relq.operators.transaction import Failure, Multi, Session, transaction, with_retries
from relq.operators.write import OnConflict
from relq.plans.compiler import Compiler
from relq.plans.queries import catalog
from relq.sources import Catalog, Entity, Field, belongs_to
from relq.sources.introspect import source_of
from relq.sources.star import Customer, Nation, Note, Orders
from relq.sources.store import Store


class Entry(Entity, table="kv"):
    id = Field("long", key=True, generated=True)
    name = Field("string")
    value = Field("string", nullable=True)
    status = Field("string", labels=("draft", "done"), nullable=True)
    version = Field("long", version=True, nullable=True)
    deleted_at = Field("timestamp_ntz", nullable=True, deleted=True)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path))


@pytest.fixture(scope="module")
def repo(spark, sf):
    return Repo(catalog(spark, sf))


def names(store):
    return {(r.name, r.value) for r in store.read(Entry).collect()}


def test_one_count_exists_page(repo):
    assert repo.one(Customer.where(lambda c: c.c_custkey == 3)).c_custkey == 3
    assert repo.one(Customer.where(lambda c: c.c_custkey == -3)) is None
    with pytest.raises(RelqError) as e:
        repo.one(Customer.query())
    assert e.value.code == 4103
    assert repo.one(Customer.query().order_by(lambda c: c.c_custkey).limit(1)).c_custkey == 0
    assert repo.count(Nation.query().limit(3).offset(2)) == 25
    assert repo.count(Nation.select(r=lambda n: n.n_regionkey).distinct()) == 5
    assert repo.exists(Nation.query()) and not repo.exists(Nation.where(lambda n: n.n_name == "x"))
    page = repo.page(Nation.query(), PageRequest(3, 10))
    assert [r.n_nationkey for r in page.items] == [20, 21, 22, 23, 24] and page.total == 25 and page.page_count == 3
    assert page.is_last and page.has_previous and (page.first_index, page.last_index) == (21, 25)
    assert PageRequest(-1, 1000) == PageRequest(1, 100)


def test_rows_as_objects_and_streams(repo):
    @dataclass
    class Named:
        key: int
        name: str

    got = repo.into(Nation.where(lambda n: n.n_nationkey < 2).select(key=lambda n: n.n_nationkey, name=lambda n: n.n_name), Named)
    assert sorted(x.key for x in got) == [0, 1]
    with repo.stream(Nation.query()) as rows:
        first = next(rows)
        assert first.n_name
    with pytest.raises(RelqError) as e:
        next(rows)
    assert e.value.code == 4110


def test_ambient_and_diagnostics(repo, spark, sf):
    with pytest.raises(RelqError) as e:
        Repo.require()
    assert e.value.code == 4102
    with repo.ambient():
        assert Repo.require() is repo
    own = Repo(catalog(spark, sf), Diagnostics(slow_seconds=0, repeats=2))
    for _ in range(2):
        own.all(Nation.limit(1))
    assert own.diagnostics.slow and own.diagnostics.repeated == ["all"] and len(own.diagnostics.durations["all"]) == 2
    assert "Scan parquet" in own.explain(Nation.query()) and "Scan parquet" in own.explain(Nation.query(), analyze=True)
    with pytest.raises(RelqError) as e:
        own.explain("INSERT INTO t VALUES (1)", analyze=True)
    assert e.value.code == 4115
    assert own.execute("SELECT :n + 1 AS x", n=4).first().x == 5
    assert "Filter" in own.debug_plan(Nation.where(lambda n: n.n_nationkey == 1))


def test_runtime_errors(repo, spark):
    many = lambda c: scalar(Orders.where(lambda o: o.o_custkey == c.c_custkey).select(k=lambda o: o.o_orderkey))
    with pytest.raises(Exception) as e:
        repo.all(Customer.select(k=many))
    assert classify(e.value) == "client_input"
    with pytest.raises(Exception) as e:
        repo.all(Nation.select(x=lambda n: n.n_regionkey / 0))
    assert classify(e.value) == "client_input"
    row = repo.one(Customer.query().order_by(lambda c: c.c_custkey).limit(1))
    with pytest.raises(RelqError) as e:
        loaded(row, "orders")
    assert e.value.code == 4109

    class Lost(Entity, table="lost"):
        id = Field("long", key=True)
        nation_id = Field("int", nullable=True)
        nation = belongs_to(Nation, "nation_id")

    frames = lambda v: repo.catalog.with_frames({"lost": spark.createDataFrame([(1, v)], "id long, nation_id int")})
    assert Repo(frames(None)).one(Lost.preload("nation")).nation is None
    with pytest.raises(Exception, match="dangling"):
        Repo(frames(99)).all(Lost.preload("nation"))
    with pytest.raises(RelqError) as e:
        Catalog(spark, None, {"nation": spark.range(1)}).frame(Nation)
    assert e.value.code == 4106
    with pytest.raises(RelqError) as e:
        Catalog(spark, None, {"lost": spark.createDataFrame([("a", 1)], "id string, nation_id int")}).frame(Lost)
    assert e.value.code == 4107


def test_fragment_values_never_become_text(repo):
    odd = "'; DROP TABLE x; -- {} `"
    assert repo.all(Nation.where(lambda n: fragment("{} = {}", n.n_name, odd))) == []
    assert repo.one(Nation.where(lambda n: n.n_nationkey == 1).select(x=lambda n: fragment("concat({}, {})", odd, "!"))).x == odd + "!"


def test_like_backslash(repo, spark):
    class T(Entity, table="t"):
        s = Field("string")

    own = Repo(repo.catalog.with_frames({"t": spark.createDataFrame([("ab",), ("a%",), ("A_",), ("a\\",)], "s string")}))
    got = lambda p: sorted(r.s for r in own.all(T.where(p)))
    assert got(lambda t: t.s.like(r"\ab")) == ["ab"]
    assert got(lambda t: t.s.like(r"a\%")) == ["a%"]
    assert got(lambda t: t.s.contains("_", any_case=True)) == ["A_"]
    assert got(lambda t: t.s.has_suffix("\\", any_case=True)) == ["a\\"]
    assert got(lambda t: t.s.has_prefix("a", any_case=True)) == ["A_", "a%", "a\\", "ab"]


def test_zone_truncation_keeps_repeated_hours(repo, spark):
    class T(Entity, table="t"):
        at = Field("timestamp")

    times = [dt.datetime(2024, 11, 3, h, 30, tzinfo=dt.timezone.utc) for h in (5, 6)]
    own = repo.catalog.with_frames({"t": spark.createDataFrame([(t,) for t in times], "at timestamp")})
    hours = Compiler(own).query(T.select(h=lambda t: t.at.truncated("hour", "America/New_York"), d=lambda t: t.at.truncated("day", "America/New_York")))
    assert [(r.h, r.d) for r in hours.selectExpr("cast(h as string) h", "cast(d as string) d").orderBy("h").collect()] == [("2024-11-03 05:00:00", "2024-11-03 04:00:00"), ("2024-11-03 06:00:00", "2024-11-03 04:00:00")]


def test_introspection(spark):
    text = source_of({"node": spark.createDataFrame([], "id long, parent_id long, tags array<string>, m map<string,int>, class string")}, {"node": ["id"]}, {"node": {"parent_id": "node"}})
    assert 'id = Field("long", key=True)' in text and "TODO m" in text and 'class_ = Field("string", nullable=True, column="class")' in text
    made: dict = {}
    exec(text, made)
    assert made["Node"].columns() == ["id", "parent_id", "tags", "class"]


def test_insert_update_delete(store):
    with transaction(store, [Entry]) as tx:
        got = tx.insert(Entry, [{"name": "a", "value": "1", "version": 1}, {"name": "b", "value": "2", "version": 1}])
        assert sorted(r.id for r in got.collect()) == [1, 2]
        assert tx.update(Entry.where(lambda e: e.name == "a"), value=lambda e: fragment("concat({}, {})", e.value, "!")) == 1
    assert names(store) == {("a", "1!"), ("b", "2")}
    with transaction(store, [Entry]) as tx:
        assert tx.soft_delete(Entry.where(lambda e: e.name == "a")) == 1
        assert tx.repo.count(Entry.query()) == 1
        assert tx.restore(Entry.where(lambda e: e.name == "a")) == 1
        assert tx.delete(Entry.where(lambda e: e.name == None)) == 0  # noqa: E711
        row = tx.repo.one(Entry.where(lambda e: e.name == "b"))
        tx.update_row(Entry, row, value="3")
        with pytest.raises(RelqError) as e:
            tx.update_row(Entry, row, value="4")
        assert e.value.code == 4104
        tx.delete_row(Entry, {"id": 1, "version": 1})
    assert names(store) == {("b", "3")}
    with pytest.raises(RelqError) as e, transaction(store, [Entry]) as tx:
        tx.insert(Entry, [{"name": "c", "status": "odd"}])
    assert e.value.code == 4108
    with pytest.raises(RelqError), transaction(store, [Entry]) as tx:
        tx.insert(Entry, [{"id": 2, "name": "c"}])


def test_batches_are_numbered(store, spark):
    with transaction(store, [Entry]) as tx:
        got = tx.insert(Entry, [{"name": x} for x in "cab"])
        assert [r.name for r in sorted(got.collect(), key=lambda r: r.id)] == ["c", "a", "b"]
    with transaction(store, [Entry]) as tx:
        tx.insert(Entry, spark.range(500).selectExpr("concat('n', id % 400) as name"))
    ids = sorted(r.id for r in store.read(Entry).collect())
    assert ids == list(range(1, 504))


def test_upsert(store):
    with transaction(store, [Entry]) as tx:
        tx.insert(Entry, [{"name": "a", "value": "1"}, {"name": "b", "value": "9"}])
    batch = [{"name": "a", "value": "5"}, {"name": "b", "value": "5"}, {"name": "c", "value": "5"}]
    with transaction(store, [Entry]) as tx:
        hit = tx.insert(Entry, batch, OnConflict.do_update("name", set=("value",), update_where=lambda e, i: e.value < i.value))
        assert {r.name for r in hit.collect()} == {"a", "c"}
    assert names(store) == {("a", "5"), ("b", "9"), ("c", "5")}
    with transaction(store, [Entry]) as tx:
        tx.insert(Entry, [{"name": "a", "value": "x"}, {"name": "d", "value": "x"}, {"name": "d", "value": "x"}], OnConflict.do_nothing("name"))
    assert names(store) == {("a", "5"), ("b", "9"), ("c", "5"), ("d", "x")}
    with pytest.raises(Exception, match="twice"), transaction(store, [Entry]) as tx:
        tx.insert(Entry, [{"name": "a"}, {"name": "a"}], OnConflict.do_update("name", set=("value",)))


def test_transactions(store):
    told = []
    with pytest.raises(KeyError), transaction(store, [Entry], (told.append,)) as tx:
        tx.insert(Entry, [{"name": "a"}])
        raise KeyError
    assert names(store) == set() and told == ["rollback"]
    with transaction(store, [Entry]) as tx:
        tx.insert(Entry, [{"name": "a"}])
        with pytest.raises(KeyError), tx.savepoint():
            tx.insert(Entry, [{"name": "b"}])
            raise KeyError
    assert names(store) == {("a", None)}
    first, second = Session(store, [Entry]), Session(store, [Entry])
    first.insert(Entry, [{"name": "x"}])
    second.insert(Entry, [{"name": "y"}])
    first.commit()
    with pytest.raises(VersionConflict):
        second.commit()
    reader = Session(store, [Entry])
    reader.all(Entry.query().lock_for_update())
    with transaction(store, [Entry]) as tx:
        tx.insert(Entry, [{"name": "z"}])
    with pytest.raises(VersionConflict):
        reader.commit()
    seen = []

    def body(tx):
        seen.append(1)
        if len(seen) == 1:
            with transaction(store, [Entry]) as other:
                other.insert(Entry, [{"name": "o"}])
        tx.insert(Entry, [{"name": "r"}])

    with_retries(store, [Entry], body, first_wait=0)
    assert len(seen) == 2 and {("o", None), ("r", None)} <= names(store)
    with pytest.raises(RelqError) as e, transaction(store, [Entry]) as tx:
        tx.rollback()
    assert e.value.code == 4101


def test_isolation_levels(store):
    def add(name):
        with transaction(store, [Entry]) as t:
            t.insert(Entry, [{"name": name}])

    add("a")
    steady, fresh = Session(store, [Entry]), Session(store, [Entry], isolation="read_committed")
    add("b")
    assert len(steady.all(Entry.query())) == 1 and len(fresh.all(Entry.query())) == 2
    assert steady.repo.count(Entry.query()) == 1 and fresh.update(Entry.query(), value="v") == 2
    fresh.commit()
    assert names(store) == {("a", "v"), ("b", "v")}
    for lock in (False, True):  # changed or locked, then changed by another: even the freshest reads do not hide that
        late = Session(store, [Entry], isolation="read_committed")
        late.all(Entry.query().lock_for_update()) if lock else late.update(Entry.query(), value="w")
        add("c")
        late.all(Entry.query())
        with pytest.raises(VersionConflict):
            late.commit()

    def reads_one_and_writes_other(level):
        t = Session(store, [Entry, Note], isolation=level)
        t.all(Entry.query())
        t.insert(Note, [{"name": level, "version": 0}])
        add("d")
        t.commit()

    reads_one_and_writes_other("repeatable_read")
    with pytest.raises(VersionConflict):
        reads_one_and_writes_other("serializable")
    assert [r.name for r in store.read(Note).collect()] == ["repeatable_read"]
    reader = Session(store, [Entry], isolation="serializable")
    add("e")
    reader.commit()
    with pytest.raises(RelqError):
        Session(store, [Entry], isolation="odd")


def test_statements_have_a_limit(repo, store, spark):
    slow = lambda e: fragment("reflect('java.lang.Thread', 'sleep', bigint({})) IS NULL", 2000)
    with pytest.raises(StatementTimeout):
        Repo(repo.catalog, timeout=0.3).all(Nation.where(slow))
    assert Repo(repo.catalog, timeout=60).count(Nation.query()) == 25
    with transaction(store, [Entry], timeout=60) as t:
        t.insert(Entry, [{"name": "a"}, {"name": "b"}])
    with pytest.raises(StatementTimeout), transaction(store, [Entry], timeout=0.3) as t:
        t.delete(Entry.where(slow))
    assert names(store) == {("a", None), ("b", None)} and len(spark.sparkContext.getJobTags()) == 0


def test_plans_of_writes(store):
    t = Session(store, [Entry])
    hit = Entry.where(lambda e: e.name == "a")
    assert "Filter" in t.debug_plan("delete", hit) and "CASE WHEN" in t.debug_plan("update", hit, value="x")
    assert "Union" in t.debug_plan("insert", Entry, [{"name": "a"}])
    assert "FullOuter" in t.debug_plan("insert", Entry, [{"name": "a"}], OnConflict.do_nothing("name"))
    assert not t.overlay and not t.made
    with pytest.raises(RelqError):
        t.debug_plan("merge", hit)


def test_errors_by_what_to_do():
    assert [classify(e) for e in (VersionConflict("t"), ConnectionResetError(), RuntimeError("ExecutorLostFailure (executor 1 exited)"), RelqError(4113), ValueError())] == ["retryable", "transient", "transient", "client_input", "other"]


def test_multi(store):
    add = Multi().step("a", lambda tx, done: tx.insert(Entry, [{"name": "a"}]).count()).step("b", lambda tx, done: done["a"] + 1)
    assert add.run(store, [Entry]) == {"a": 1, "b": 2}
    failed = add.merge(Multi().step("c", lambda tx, done: 1 / 0)).run(store, [Entry])
    assert isinstance(failed, Failure) and failed.step == "c" and failed.done["b"] == 2
    assert names(store) == {("a", None)}
    with pytest.raises(RelqError):
        add.step("a", lambda tx, done: None)


def test_transaction_time_is_one(store):
    tx = Session(store, [Entry])
    tx.insert(Entry, [{"name": "a"}])
    assert len({tx.repo.frame(Entry.select(t=now())).select(F.col("t").cast("string")).first()[0] for _ in range(2)}) == 1


def test_stored_forms(spark):
    from relq.functions import codec

    t = dt.time(23, 59, 58, 7)
    assert codec.micros_to_time(codec.time_to_micros(t)) == t
    with pytest.raises(RelqError):
        codec.micros_to_time(codec.DAY)
    assert codec.from_json(codec.to_json({"b": [1, None], "a": "é"})) == {"a": "é", "b": [1, None]}
    with pytest.raises(RelqError):
        codec.from_json("{")
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 12), codec.interval(1, 1, 1_500_000), '{"k": 3}')], "at timestamp_ntz, i struct<months:int,days:int,micros:long>, j string")
    from pyspark.sql import types as T

    row = df.select(codec.add_interval(F.col("at"), F.col("i")).alias("x"), codec.json_column(F.col("j"), T.StructType([T.StructField("k", T.IntegerType())])).alias("j")).first()
    assert row.x == dt.datetime(2024, 3, 1, 12, 0, 1, 500_000) and row.j.k == 3


def test_versions_are_lists_of_folders(store, spark, tmp_path):
    with transaction(store, [Entry]) as t:
        t.insert(Entry, spark.range(1000).select(F.col("id"), F.lit("n").alias("name")))
    first = store.folders("kv", 1)
    with transaction(store, [Entry]) as t:
        t.insert(Entry, [{"name": "one more"}])
    assert store.folders("kv", 2)[:1] == first and len(store.folders("kv", 2)) == 2 and store.read(Entry).count() == 1001
    assert store.read(Entry, 1).count() == 1000
    on_disk = {p.name for p in (tmp_path / "kv").iterdir() if p.name.startswith("v-")}
    with pytest.raises(RelqError), transaction(store, [Entry]) as t:
        t.insert(Entry, [{"id": 5, "name": "again"}])
    with pytest.raises(RelqError), transaction(store, [Entry]) as t:
        t.insert(Entry, [{"id": 5000, "name": "a"}, {"id": 5000, "name": "b"}])
    assert {p.name for p in (tmp_path / "kv").iterdir() if p.name.startswith("v-")} == on_disk  # what was staged is gone
    with transaction(store, [Entry]) as t:
        t.delete(Entry.where(lambda e: e.id < 990))
    assert set(store.vacuum(Entry, keep=1, hours=-1)) == on_disk and store.read(Entry).count() == 11


def test_a_pointer_is_whole_or_not_there(store, tmp_path):
    with transaction(store, [Entry]) as t:
        t.insert(Entry, [{"name": "a"}])
    (tmp_path / "kv/_versions/_left-by-a-crash").write_text("")
    assert store.version("kv") == 1 and names(store) == {("a", None)}
    late = Session(store, [Entry])
    late.insert(Entry, [{"name": "late"}])
    assert store._moved(store._fs(), store._path(f"{store.folder}/kv/_versions/_left-by-a-crash"), store._path(f"{store.folder}/kv/_versions/1")) is False
    with transaction(store, [Entry]) as t:
        t.insert(Entry, [{"name": "b"}])
    with pytest.raises(VersionConflict):
        late.commit()
    (tmp_path / "kv/_versions/3").write_text("")
    with pytest.raises(RelqError):
        store.read(Entry)


def test_preloads_keep_the_order_without_broadcasts(spark, sf):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = Repo(catalog(spark, sf)).all(Customer.query().order_by(lambda c: (c.c_acctbal.desc(), c.c_custkey)).limit(30).preload("orders").preload("nation"))
        every = Repo(catalog(spark, sf)).all(Orders.query().order_by(lambda o: o.o_totalprice).preload("customer"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert [r.c_acctbal for r in rows] == sorted((r.c_acctbal for r in rows), reverse=True) and len(rows) == 30
    assert rows[0].__fields__ == [*Customer.columns(), "orders", "nation"]
    assert [r.o_totalprice for r in every] == sorted(r.o_totalprice for r in every)


def test_recursion_beyond_a_million_rows(spark):
    from relq.operators.query import Recursive
    from relq.sources.star import Node

    n = 1_200_000
    frame = spark.range(1, n).select("id", F.when(F.col("id") > 1, F.expr("id div 200")).alias("parent_id"), F.lit(1).alias("size"))
    own = Repo(Catalog(spark, None, {"nodes": frame.withColumn("parent_id", F.expr("greatest(parent_id, least(1, id - 1))"))}))
    tree = lambda levels: Recursive("tree", Node.where(lambda x: x.id == 1).select(id=lambda x: x.id), Node, lambda x, t: x.parent_id == t.id, levels=levels).query()
    assert own.count(tree(100)) == n - 1
    with pytest.raises(RelqError):
        own.count(tree(2))
