"""Queries over the driver's tables, each with the SQL whose result it equals."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.functions import predicates as P
from rowmill.operators import joins as J
from rowmill.operators import select as S
from rowmill.operators import versions as V
from rowmill.sources.shared import shared_folder
from rowmill.sources.tables import Conflict, Table
from rowmill.streaming import replicas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        SQL[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/rowmill-table-{uuid.uuid4().hex}"


# scans, projection, predicates


@query("SELECT * FROM nation")
def scan_star(t):
    return t("nation")


@query("SELECT c_custkey, c_name FROM customer")
def project_cols(t):
    return S.project(t("customer"), "c_custkey", "c_name")


@query("SELECT * FROM orders WHERE o_orderkey = 42")
def pk_point(t):
    d = t("orders")
    return d.filter(P.compare(d, "o_orderkey", "=", 42))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 14900")
def pk_range(t):
    d = t("orders")
    return S.project(d.filter(P.compare(d, "o_orderkey", ">=", 14900)), "o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_custkey >= 0")
def secondary_lookup(t):
    d = t("customer")
    return S.project(d.filter(P.compare(d, "c_nationkey", "=", 7)), "c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment != 'BUILDING'")
def filter_ne_text(t):
    d = t("customer")
    return S.project(d.filter(P.compare(d, "c_mktsegment", "!=", "BUILDING")), "c_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 5 AND p_brand = 'Brand#11' OR p_size = 50")
def filter_dnf(t):
    d = t("part")
    small = (P.compare(d, "p_size", "<", 5), P.compare(d, "p_brand", "=", "Brand#11"))
    return S.project(d.filter(P.any_of(small, [P.compare(d, "p_size", "=", 50)])), "p_partkey", "p_size")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12")
def filter_between(t):
    d = t("part")
    return S.project(d.filter(P.between(d, "p_size", 10, 12)), "p_partkey")


@query("SELECT n_name FROM nation WHERE n_name LIKE '%_1%'")
def filter_like(t):
    d = t("nation")
    return S.project(d.filter(P.like(d, "n_name", "%_1%")), "n_name")


@query("SELECT p_partkey FROM part WHERE p_type NOT LIKE '_____'")
def filter_not_like(t):
    d = t("part")
    return S.project(d.filter(P.not_like(d, "p_type", "_____")), "p_partkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1_'")
def like_selective(t):
    d = t("part")
    return S.project(d.filter(P.like(d, "p_brand", "Brand#1_")), "p_partkey", "p_brand")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)")
def in_list(t):
    d = t("nation")
    return S.project(d.filter(P.in_values(d, "n_regionkey", [1, 3])), "n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, 3)")
def not_in_list(t):
    d = t("nation")
    return S.project(d.filter(P.not_in_values(d, "n_regionkey", [1, None, 3])), "n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE FALSE")
def mixed_types(t):
    d = t("nation")
    return S.project(d.filter(P.compare(d, "n_nationkey", "!=", "7")), "n_nationkey")


@query("SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_linenumber IS NULL")
def is_null_after_join(t):
    d = J.chain(("o", t("orders")), ("l", t("lineitem"), "left", "o.o_orderkey", "l.l_orderkey"))
    return J.pick(d.filter(P.is_null(d, "l__l_linenumber")), o_orderkey="o.o_orderkey")


# subqueries


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def in_subquery(t):
    n = t("nation")
    return S.project(J.in_query(t("customer"), "c_nationkey", S.project(n.filter(P.compare(n, "n_regionkey", "=", 2)), "n_nationkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))")
def nested_subquery(t):
    r = t("region")
    nations = J.in_query(t("nation"), "n_regionkey", S.project(r.filter(P.like(r, "r_name", "A%")), "r_regionkey"))
    return S.project(J.in_query(t("customer"), "c_nationkey", S.project(nations, "n_nationkey")), "c_custkey")


@query("SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def scalar_subquery(t):
    r = t("region")
    return S.project(J.compare_query(t("nation"), "n_regionkey", "=", S.project(r.filter(P.compare(r, "r_name", "=", "ASIA")), "r_regionkey")), "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey > (SELECT MAX(s_suppkey) FROM supplier)")
def scalar_subquery_gt(t):
    top = S.aggregate(t("supplier"), {"top": ("max", "s_suppkey")})
    return S.project(J.compare_query(t("customer"), "c_custkey", ">", top), "c_custkey")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.quality = 1 AND l.doc_id = d.doc_id)")
def not_in_subquery_ref(t):
    labels = t("labels")
    return S.project(J.not_in_query(t("documents"), "doc_id", S.project(labels.filter(P.compare(labels, "quality", "=", 1)), "doc_id")), "doc_id")


@query("""SELECT p_partkey FROM part p WHERE p_partkey IS NOT NULL AND NOT EXISTS
(SELECT 1 FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_totalprice < 6000 AND l.l_partkey = p.p_partkey)""")
def not_in_null_set_ref(t):
    d = J.chain(("o", t("orders")), ("l", t("lineitem"), "left", "o_orderkey", "l_orderkey"))
    return S.project(J.not_in_query(t("part"), "p_partkey", J.pick(d.filter(P.compare(d, "o__o_totalprice", "<", 6000)), k="l_partkey")), "p_partkey")


# joins


@query("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def inner_join(t):
    return J.pick(J.chain(("n", t("nation")), ("r", t("region"), "inner", "n.n_regionkey", "r.r_regionkey")), n_name="n.n_name", r_name="r.r_name")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
def left_join(t):
    return J.pick(J.chain(("c", t("customer")), ("o", t("orders"), "left", "c.c_custkey", "o.o_custkey")), c_custkey="c_custkey", o_orderkey="o_orderkey")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def self_join(t):
    return J.pick(J.chain(("a", t("nation")), ("b", t("nation"), "inner", "a.n_regionkey", "b.n_regionkey")), a_name="a.n_name", b_name="b.n_name")


@query("""SELECT r.r_name, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""")
def five_way_join_agg(t):
    d = J.chain(
        ("l", t("lineitem")), ("o", t("orders"), "inner", "l_orderkey", "o_orderkey"), ("c", t("customer"), "inner", "o_custkey", "c_custkey"),
        ("n", t("nation"), "inner", "c_nationkey", "n_nationkey"), ("r", t("region"), "inner", "n_regionkey", "r_regionkey"),
    )
    return S.aggregate(d, {"r_name": ("key",), "n": ("count",)}, by="r__r_name")


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_docs(t):
    return S.project(J.unmatched(t("documents"), "doc_id", t("labels"), "doc_id"), "doc_id")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def anti_join_orders(t):
    return S.project(J.unmatched(t("orders"), "o_orderkey", t("lineitem"), "l_orderkey"), "o_orderkey")


# aggregates


@query("SELECT COUNT(*) AS n, COUNT(p_size) AS n_size, CAST(SUM(p_size) AS BIGINT) AS s, MIN(p_size) AS lo, MAX(p_size) AS hi, AVG(p_size) AS mean FROM part")
def global_aggs(t):
    return S.aggregate(t("part"), {"n": ("count",), "n_size": ("count", "p_size"), "s": ("sum", "p_size"), "lo": ("min", "p_size"), "hi": ("max", "p_size"), "mean": ("avg", "p_size")})


@query("SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s, MIN(p_name) AS lo, AVG(p_size) AS mean FROM part WHERE p_size < 0")
def empty_aggs(t):
    d = t("part")
    return S.aggregate(d.filter(P.compare(d, "p_size", "<", 0)), {"n": ("count",), "s": ("sum", "p_size"), "lo": ("min", "p_name"), "mean": ("avg", "p_size")})


@query("SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
def group_by(t):
    return S.aggregate(t("orders"), {"o_orderstatus": ("key",), "n": ("count",), "s": ("sum", "o_custkey")}, by="o_orderstatus")


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15")
def having(t):
    return S.aggregate(t("orders"), {"o_custkey": ("key",), "n": ("count",)}, by="o_custkey", having=("count", None, ">", 15))


@query("SELECT p_brand FROM part GROUP BY p_brand HAVING MAX(p_name) > 'part_1'")
def having_hidden(t):
    return S.aggregate(t("part"), {"p_brand": ("key",)}, by="p_brand", having=("max", "p_name", ">", "part_1"))


@query("SELECT n_regionkey, MIN(n_regionkey) AS any_region, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
def bare_column(t):
    return S.aggregate(t("nation"), {"n_regionkey": ("key",), "any_region": ("first", "n_regionkey"), "n": ("count",)}, by="n_regionkey")


@query("SELECT MIN(p_name) AS lo, MAX(p_name) AS hi FROM part")
def min_max_text(t):
    return S.aggregate(t("part"), {"lo": ("min", "p_name"), "hi": ("max", "p_name")})


@query("SELECT l.quality, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality")
def null_group(t):
    d = J.chain(("d", t("documents")), ("l", t("labels"), "left", "d.doc_id", "l.doc_id"))
    return S.aggregate(d, {"quality": ("key",), "n": ("count",)}, by="l__quality")


@query("SELECT c.c_custkey, COUNT(*) AS n, COUNT(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
def left_join_counts(t):
    d = J.chain(("c", t("customer")), ("o", t("orders"), "left", "c_custkey", "o_custkey"))
    return S.aggregate(d, {"c_custkey": ("key",), "n": ("count",), "n_orders": ("count", "o__o_orderkey")}, by="c__c_custkey")


@query("""SELECT o.o_orderkey, COUNT(*) AS n, COUNT(l.l_linenumber) AS n_lines, CAST(SUM(l.l_linenumber) AS BIGINT) AS s
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
def left_join_null_counts(t):
    d = J.chain(("o", t("orders")), ("l", t("lineitem"), "left", "o_orderkey", "l_orderkey"))
    return S.aggregate(d, {"o_orderkey": ("key",), "n": ("count",), "n_lines": ("count", "l__l_linenumber"), "s": ("sum", "l__l_linenumber")}, by="o__o_orderkey")


# distinct, order, limit


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_multi(t):
    return S.distinct(t("customer"), "c_mktsegment", "c_nationkey")


@query("SELECT DISTINCT * FROM region")
def distinct_star(t):
    return S.distinct(t("region").union(t("region")))


@query("SELECT DISTINCT l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def distinct_null(t):
    return S.distinct(J.pick(J.chain(("d", t("documents")), ("l", t("labels"), "left", "d.doc_id", "l.doc_id")), quality="quality"))


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY 2 DESC, o_custkey LIMIT 10")
def topk_by_agg(t):
    return S.ordered(S.aggregate(t("orders"), {"o_custkey": ("key",), "n": ("count",)}, by="o_custkey"), -2, "o_custkey", limit=10)


@query("SELECT o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(t):
    return S.project(S.ordered(t("orders"), "-o_custkey", "o_orderkey", limit=10, offset=5), "o_orderkey")


def _quality(t):
    return J.pick(J.chain(("d", t("documents")), ("l", t("labels"), "left", "d.doc_id", "l.doc_id")), doc_id="d.doc_id", quality="quality")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS LAST, d.doc_id LIMIT 420")
def null_sort_asc_limit(t):
    return S.ordered(_quality(t), "quality", "doc_id", limit=420)


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS FIRST, d.doc_id LIMIT 650")
def null_sort_desc_limit(t):
    return S.ordered(_quality(t), "-quality", "doc_id", limit=650)


@query("SELECT n_nationkey FROM nation LIMIT 0")
def limit_zero(t):
    return S.ordered(S.project(t("nation"), "n_nationkey"), limit=0)


# versions


@query("SELECT user_id, MAX(event_id) AS event_id FROM events GROUP BY user_id")
def latest_per_key(t):
    e = t("events").select("user_id", "event_id", F.lit(False).alias("tomb"))
    return V.newest(e, "user_id", order="event_id").select("user_id", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) e
WHERE rn = 1 AND event_type <> 'error'""")
def kv_merge_tombstone(t):
    e = t("events").select("user_id", "event_id", (F.col("event_type") == "error").alias("tomb"))
    return V.newest(e, "user_id", order="event_id").select("user_id", "event_id")


@query("""SELECT user_id, event_type, MAX(event_id) AS event_id FROM events GROUP BY user_id, event_type HAVING MAX(event_id) % 7 <> 0""")
def kv_merge_multi_value(t):
    e = t("events").select("user_id", "event_type", "event_id", (F.col("event_id") % 7 == 0).alias("tomb"))
    return V.newest(e, "user_id", "event_type", order="event_id").select("user_id", "event_type", "event_id")


@query("""SELECT event_id FROM events WHERE event_id % 4 = 0 AND event_id < 9000
AND NOT (event_id % 5 = 0 AND event_id % 10 <> 5 AND (event_id + 2) % 4 = 0 AND event_id + 2 < 9000)""")
def visibility_filter(t):
    e = t("events").select("event_id", F.col("event_id").alias("xmin"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") + 2).otherwise(0).alias("xmax"))
    status = F.when(F.col("event_id") % 4 == 0, "committed").when(F.col("event_id") % 4 == 1, "aborted").otherwise("running")
    return V.visible(e, t("events").select(F.col("event_id").alias("txn"), status.alias("status")), snapshot=9000).select("event_id")


@query("SELECT COUNT(*) AS n FROM events WHERE user_id BETWEEN 10 AND 40")
def range_count(t):
    return V.range_count(t("events"), "user_id", 10, 40)


@query("SELECT c_custkey AS txn FROM customer WHERE c_custkey < 100 AND c_custkey % 10 < 3")
def deadlocked(t):
    # every customer waits for the next, but for ten who close circles of three
    k = F.col("c_custkey")
    return V.deadlocked(t("customer").select(k.alias("waiter"), F.when((k < 100) & (k % 10 == 2), k - 2).otherwise(k + 1).alias("holder")))


@query("SELECT DISTINCT n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) g")
def distinct_of_groups(t):
    return S.distinct(S.aggregate(t("orders"), {"o_custkey": ("key",), "n": ("count",)}, by="o_custkey"), "n")


@query("SELECT n.n_name, r.r_name, s.s_suppkey FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey JOIN supplier s ON n.n_regionkey = r.r_regionkey")
def join_on_earlier_tables(t):
    d = J.chain(("n", t("nation")), ("r", t("region"), "inner", "n.n_regionkey", "r.r_regionkey"), ("s", t("supplier"), "inner", "n.n_regionkey", "r.r_regionkey"))
    return J.pick(d, n_name="n_name", r_name="r_name", s_suppkey="s_suppkey")


@query("""WITH q AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT q.doc_id, r.r_name FROM q LEFT JOIN region r ON q.quality = r.r_regionkey""")
def join_null_keys(t):
    d = J.chain(("q", _quality(t)), ("r", t("region"), "left", "q.quality", "r.r_regionkey"))
    return J.pick(d, doc_id="doc_id", r_name="r_name")


@query("SELECT COUNT(*) AS n FROM orders WHERE o_custkey = NULL OR (o_custkey <> NULL AND o_orderkey > 0) OR o_orderstatus = 'F'")
def compared_with_null(t):
    o = t("orders")
    rows = o.filter(P.any_of([P.compare(o, "o_custkey", "=", None)], [P.compare(o, "o_custkey", "!=", None), P.compare(o, "o_orderkey", ">", 0)], [P.compare(o, "o_orderstatus", "=", "F")]))
    return S.aggregate(rows, {"n": ("count",)})


@query("SELECT c.c_custkey FROM customer c WHERE c.c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def one_column_subqueries(t):
    customer, orders = t("customer"), t("orders")
    try:
        J.in_query(customer, "c_custkey", orders.select("o_custkey", "o_orderkey"))
    except ValueError:
        return S.project(J.not_in_query(customer, "c_custkey", S.project(orders, "o_custkey")), "c_custkey")
    raise AssertionError("a subquery of two columns was taken")


# tables with snapshots


def _table(t, keep: str | None = None) -> Table:
    orders = t("orders") if keep is None else t("orders").filter(keep)
    rows = orders.select(F.col("o_orderkey").cast("long"), F.col("o_orderstatus").cast("string"), F.col("o_custkey").cast("long"))
    schema = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_custkey", T.LongType())])
    table = Table(rows.sparkSession, folder(rows.sparkSession), schema)
    table.insert(rows)
    return table


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 1 THEN 'changed' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders WHERE o_custkey % 5 <> 2")
def dml_update_delete(t):
    table = _table(t)
    table.update({"o_orderstatus": F.lit("changed")}, F.col("o_custkey") % 5 == 1)
    table.delete(F.col("o_custkey") % 5 == 2)
    return table.read()


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def snapshot_read(t):
    table = _table(t)
    begun = table.begin()
    table.delete(F.col("o_custkey") % 2 == 0)
    return begun.read()


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def snapshot_read_after_vacuum(t):
    table = _table(t)
    begun = table.begin()
    table.delete(F.col("o_custkey") % 2 == 0)
    table.vacuum()
    return begun.read()


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def rollback(t):
    table = _table(t)
    begun = table.begin()
    begun.delete()
    begun.rollback()
    return table.read()


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT -1, 'N', 0")
def own_changes(t):
    table = _table(t)
    begun = table.begin()
    begun.delete(F.col("o_custkey") % 5 == 0)
    begun.insert(table.spark.sql("SELECT -1L, 'N', 0L"))
    return begun.read()


@query("SELECT o_orderkey, 'first' AS o_orderstatus, o_custkey FROM orders")
def first_updater_wins(t):
    table = _table(t)
    first, second, reader = table.begin(), table.begin(), table.begin()
    first.update({"o_orderstatus": F.lit("first")})
    second.update({"o_orderstatus": F.lit("second")})
    first.commit()
    try:
        second.commit()
    except Conflict:
        # one that only reads has nothing to conflict with
        reader.commit()
        return table.read()
    raise AssertionError("both have committed")


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_custkey % 2 = 1")
def vacuum(t):
    table = _table(t)
    table.delete(F.col("o_custkey") % 2 == 0)
    table.vacuum()
    return table.read()


@query("SELECT COUNT(*) AS rows, MIN(o_orderkey) AS min_o_orderkey, MAX(o_orderkey) AS max_o_orderkey, MIN(o_orderstatus) AS min_o_orderstatus, MAX(o_orderstatus) AS max_o_orderstatus, MIN(o_custkey) AS min_o_custkey, MAX(o_custkey) AS max_o_custkey FROM orders WHERE o_custkey > 3")
def analyze(t):
    table = _table(t, "o_custkey > 3")
    table.analyze()
    return Table(table.spark, table.path).analyzed()


@query("SELECT o_orderkey, o_orderstatus, o_custkey + 10 AS o_custkey FROM orders WHERE o_custkey % 3 <> 0")
def replica(t):
    source = _table(t)
    copy = Table(source.spark, folder(source.spark), source.schema)
    where = folder(source.spark)
    replicas.follow(source, copy, where).awaitTermination()
    source.delete(F.col("o_custkey") % 3 == 0)
    source.update({"o_custkey": F.col("o_custkey") + 10})
    replicas.follow(source, copy, where).awaitTermination()
    return copy.read()


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_custkey % 3 <> 0")
def replica_of_vacuumed_table(t):
    source = _table(t)
    source.delete(F.col("o_custkey") % 3 == 0)
    source.vacuum()
    copy = Table(source.spark, folder(source.spark), source.schema)
    replicas.follow(source, copy, folder(source.spark)).awaitTermination()
    return copy.read()


@query("SELECT 2 AS before, 0 AS after")
def replica_lag(t):
    source = _table(t)
    source.delete(F.col("o_custkey") % 3 == 0)
    copy = Table(source.spark, folder(source.spark), source.schema)
    before = replicas.lag(source, copy)
    replicas.follow(source, copy, folder(source.spark)).awaitTermination()
    return source.spark.range(1).select(F.lit(before).alias("before"), F.lit(replicas.lag(source, copy)).alias("after"))
