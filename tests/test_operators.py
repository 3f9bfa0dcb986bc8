"""Small fixtures with the answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from rowmill.functions import predicates as P
from rowmill.operators import joins as J
from rowmill.operators import select as S
from rowmill.operators import versions as V


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "kim"), (2, "lee"), (3, "park"), (4, "amy")], "id int, name string")


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(1, "eng", 100), (2, "eng", 200), (3, "sales", 50), (4, "sales", 150), (5, "sales", 300)], "id int, dept string, amt int")


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([(10, 1, "book"), (11, 1, "pen"), (12, 2, "desk"), (13, 9, "ghost")], "oid int, uid int, item string")


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def names(df):
    return sorted(r.name for r in df.collect())


def test_dnf(users):
    keep = P.any_of([P.compare(users, "id", "=", 2), P.compare(users, "name", "=", "lee")], [P.compare(users, "id", "=", 4)])
    assert names(users.filter(keep)) == ["amy", "lee"]


@pytest.mark.parametrize("op", ["=", "!=", "<", ">", "<=", ">="])
def test_number_and_text_never_compare(users, op):
    assert users.filter(P.compare(users, "id", op, "1")).count() == 0
    assert users.filter(P.compare(users, "name", op, 1)).count() == 0
    assert users.filter(P.compare(users, "name", op, None)).count() == 0


def test_like_has_no_escape(spark):
    d = spark.createDataFrame([("a\\b",), ("a%b",), ("äxb",), (None,)], "s string")
    assert d.filter(P.like(d, "s", "a\\b")).count() == 1
    assert d.filter(P.like(d, "s", "_xb")).count() == 1
    assert d.filter(P.not_like(d, "s", "a%")).count() == 1


def test_in_lists_ignore_nulls(nulls):
    assert rows(nulls.filter(P.not_in_values(nulls, "name", ["b", None]))) == [(1, "a")]
    assert rows(nulls.filter(P.not_in_values(nulls, "name", []))) == [(1, "a")]
    assert rows(nulls.filter(P.in_values(nulls, "name", ["a", None]))) == [(1, "a")]


def test_unknown_column(users):
    with pytest.raises(ValueError):
        P.compare(users, "nope", "=", 1)
    with pytest.raises(ValueError):
        P.compare(users, "ID", "=", 1)


def test_nulls_sort_as_largest(nulls):
    assert [r[0] for r in rows(S.ordered(nulls, "name"))] == [1, 2]
    assert [r[0] for r in rows(S.ordered(nulls, "-name"))] == [2, 1]
    assert [r[0] for r in rows(S.ordered(nulls, -2, limit=1))] == [2]
    with pytest.raises(ValueError):
        S.ordered(nulls, 3)


def test_groups(sales):
    got = S.aggregate(sales, {"dept": ("key",), "n": ("count",), "s": ("sum", "amt")}, by="dept")
    assert sorted(rows(got)) == [("eng", 2, 300), ("sales", 3, 500)]
    assert rows(S.aggregate(sales, {"dept": ("key",)}, by="dept", having=("sum", "amt", ">", 400))) == [("sales",)]
    mean = dict(rows(S.aggregate(sales, {"dept": ("key",), "m": ("avg", "amt")}, by="dept")))
    assert mean["eng"] == 150 and f"{mean['sales']:g}" == "166.667"


def test_aggregate_errors(sales):
    for bad in ({"s": ("sum", "dept")}, {"s": ("median", "amt")}, {"s": ("sum",)}, {"k": ("key",)}):
        with pytest.raises(ValueError):
            S.aggregate(sales, bad)
    with pytest.raises(ValueError):
        S.aggregate(sales, {"n": ("count",)}, having=("count", None, ">", 1))


def test_aggregates_skip_nulls(spark):
    d = spark.createDataFrame([(1, 10), (2, None)], "id int, v int")
    assert rows(S.aggregate(d, {"n": ("count",), "c": ("count", "v"), "s": ("sum", "v")})) == [(2, 1, 10)]
    assert rows(S.aggregate(d.filter("id > 9"), {"n": ("count",), "s": ("sum", "v"), "f": ("first", "v")})) == [(0, None, None)]


def test_big_sums(spark):
    d = spark.range(1, 6001).selectExpr("cast(id as int) id", "cast(if(id % 10 = 0, null, id) as int) v")
    got = rows(S.aggregate(d, {"n": ("count",), "c": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}))
    assert got == [(6000, 5400, 16200000, 1, 5999)]


def test_joins(users, orders):
    inner = J.chain(("users", users), ("orders", orders, "inner", "users.id", "orders.uid"))
    assert inner.count() == 3
    left = J.chain(("users", users), ("orders", orders, "left", "id", "uid"))
    counts = S.aggregate(left, {"name": ("key",), "n": ("count",), "c": ("count", "orders__oid")}, by="users__name")
    assert sorted(rows(counts)) == [("amy", 1, 0), ("kim", 2, 2), ("lee", 1, 1), ("park", 1, 0)]
    assert names(J.unmatched(users, "id", orders, "uid")) == ["amy", "park"]


def test_three_tables_and_self_join(spark, users, orders):
    products = spark.createDataFrame([(10, "A"), (11, "B")], "pid int, pname string")
    chain = J.chain(("u", users), ("o", orders, "inner", "id", "uid"), ("p", products, "inner", "oid", "pid"))
    assert sorted(rows(J.pick(chain, item="o.item", pname="pname"))) == [("book", "A"), ("pen", "B")]
    emp = spark.createDataFrame([(1, "ceo", 0), (2, "alice", 1), (3, "bob", 1)], "id int, name string, mgr int")
    pairs = J.pick(J.chain(("e", emp), ("m", emp, "inner", "e.mgr", "m.id")), name="e.name", boss="m.name")
    assert sorted(rows(pairs)) == [("alice", "ceo"), ("bob", "ceo")]


def test_join_of_number_and_text_is_empty(users):
    assert J.chain(("a", users), ("b", users, "inner", "a.id", "b.name")).count() == 0
    assert J.chain(("a", users), ("b", users, "left", "a.id", "b.name")).count() == 4


def test_first_name_in_the_chain_wins(users):
    chain = J.chain(("a", users), ("b", users, "inner", "a.id", "b.id"))
    assert J.resolve(chain, "name") == "a__name"
    with pytest.raises(ValueError):
        J.resolve(chain, "a.nope")


def test_subqueries(spark, users):
    picks = spark.createDataFrame([(2,), (4,), (None,)], "uid int")
    assert names(J.in_query(users, "id", picks)) == ["amy", "lee"]
    assert names(J.not_in_query(users, "id", picks)) == ["kim", "park"]
    one = picks.filter("uid = 2")
    assert names(J.compare_query(users, "id", ">", one)) == ["amy", "park"]
    assert J.compare_query(users, "id", "=", one.filter("uid = 7")).count() == 0
    with pytest.raises(Exception, match="several rows"):
        J.compare_query(users, "id", "=", picks.filter("uid is not null")).collect()
    with pytest.raises(ValueError):
        J.in_query(users, "id", users)


def test_plans(users, orders):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(S.ordered(users, "-name", limit=2, offset=1))
    assert "LeftSemi" in plan(J.in_query(users, "id", S.project(orders, "uid")))
    assert "LeftAnti" in plan(J.not_in_query(users, "id", S.project(orders, "uid")))
    assert plan(S.aggregate(users, {"n": ("count",)}, by="name")).count("HashAggregate") >= 2


def test_visibility(spark):
    r = spark.createDataFrame([(1, 1, 0), (2, 1, 2), (3, 2, 0), (4, 3, 0), (5, 1, 3), (6, 9, 0), (7, 9, 9)], "id int, xmin int, xmax int")
    t = spark.createDataFrame([(1, "committed"), (2, "aborted"), (3, "running"), (9, "running")], "txn int, status string")
    assert sorted(x.id for x in V.visible(r, t, 4).collect()) == [1, 2, 5]
    assert sorted(x.id for x in V.visible(r, t, 4, me=9).collect()) == [1, 2, 5, 6]
    assert sorted(x.id for x in V.visible(r, t, 4, me=3).collect()) == [1, 2, 4]


def test_newest(spark):
    e = spark.createDataFrame([(k, 10 * k, False, k) for k in range(40)] + [(5, 5555, False, 50), (7, 0, True, 51)], "k long, val long, tomb boolean, seq long")
    got = {r.k: r.val for r in V.newest(e, "k").collect()}
    assert len(got) == 39 and got[5] == 5555 and 7 not in got
    multi = spark.createDataFrame([(1, 1, False, 1), (1, 2, False, 2), (1, 1, True, 3)], "k long, val long, tomb boolean, seq long")
    assert [(r.k, r.val) for r in V.newest(multi, "k", "val").collect()] == [(1, 2)]


def test_deadlocks(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (7, 8), (8, 7)]
    waits = spark.createDataFrame(edges, "waiter int, holder int")
    assert sorted(r.txn for r in V.deadlocked(waits).collect()) == [1, 2, 3, 7, 8]
    assert V.deadlocked(waits.filter("waiter > 3 and waiter < 7")).count() == 0
    assert waits.filter(F.lit(False)).count() == 0


def test_deadlocks_of_long_chains(spark):
    n = 4000
    chain = spark.range(n).select(F.col("id").alias("waiter"), (F.col("id") + 1).alias("holder"))
    assert V.deadlocked(chain).count() == 0
    # a circle at both ends of the chain, and a branch off its middle that ends
    ends = spark.createDataFrame([(-1, 0), (0, -1), (n, n + 1), (n + 1, n), (n // 2, 9000), (9000, 9001)], "waiter long, holder long")
    assert sorted(r.txn for r in V.deadlocked(chain.union(ends)).collect()) == list(range(-1, n + 2))
    assert [r.txn for r in V.deadlocked(chain.union(ends.filter("waiter < 0 or holder < 0"))).orderBy("txn").collect()] == [-1, 0]


def test_deadlocks_equal_peeling(spark):
    import random

    rnd = random.Random(3)
    for n, m in ((12, 12), (30, 40), (60, 70)):
        edges = left = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}
        while (kept := {(a, b) for a, b in left if any(b == x for x, _ in left) and any(a == y for _, y in left)}) != left:
            left = kept
        assert {r.txn for r in V.deadlocked(spark.createDataFrame(list(edges), "waiter int, holder int")).collect()} == {a for a, _ in left}


def test_deadlocked_query_reads_all_customers(spark, tmp_path, monkeypatch):
    from rowmill.plans.queries import QUERIES

    spark.range(3000).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    read, run = [], V.deadlocked
    monkeypatch.setattr(V, "deadlocked", lambda waits: read.append(waits.count()) or run(waits))
    found = sorted(r.txn for r in QUERIES["deadlocked"](spark, str(tmp_path)).collect())
    assert read == [3000] and found == [k for k in range(100) if k % 10 < 3]


def test_helper_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5), (7, 0, 0, 0, 0)], "id int, member int, value int, single int, _member int")
    ids = spark.createDataFrame([(1,), (None,)], "member int")
    assert [r.id for r in J.in_query(df, "id", ids).collect()] == [1]
    assert [r.id for r in J.not_in_query(df, "id", ids).collect()] == [7]
    assert [r.id for r in J.unmatched(df, "id", ids, "member").collect()] == [7]
    one = spark.createDataFrame([(5,)], "value int")
    assert [tuple(r) for r in J.compare_query(df, "id", ">", one).collect()] == [(7, 0, 0, 0, 0)]
    named = spark.createDataFrame([(1, 2, 3)], "key int, having int, none int")
    got = S.aggregate(named, {"key": ("key",), "having": ("max", "having"), "none": ("count",)}, by="key", having=("sum", "none", ">", 1)).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1)]
