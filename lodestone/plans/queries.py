"""The registered queries for the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import casts
from lodestone.functions.ordering import MAX, MIN
from lodestone.operators import relational as ops
from lodestone.operators.relational import SortOptions
from lodestone.sources.staging import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LINE_COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


# scans, filters, projections


@query(f"SELECT {LINE_COLUMNS} FROM lineitem")
def scan_full(spark, sf):
    return table(spark, sf, "lineitem")


@query("SELECT event_id, user_id, event_type, value FROM events")
def scan_pruned(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def filter_callback(spark, sf):
    """A Python function decides, over batches of the two columns that it reads."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return ops.filter_rows(lines, lambda quantity, flag: (quantity > 45) & (flag == "R"), ["l_quantity", "l_returnflag"])


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer WHERE nullif(c_nationkey, 3) % 2 = 0")
def filter_callback_nulls(spark, sf):
    """What a function says of a null is taken as no."""
    return ops.filter_rows(_nullable(spark, sf), lambda k: k % 2 == 0, ["k"])


@query("""SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS BIGINT) AS place
FROM orders WHERE o_orderstatus = 'F'""")
def filter_sorted(spark, sf):
    """A function filters sorted rows, whose order stays."""
    ordered = ops.sort_rows(table(spark, sf, "orders").select("o_totalprice", "o_orderkey", "o_orderstatus"), 2, [False, True])
    found = ops.filter_rows(ordered, lambda status: status == "F", ["o_orderstatus"])
    return ops.number_in_order(found, _parts(spark), "place").select("o_orderkey", "o_totalprice", "place")


@query("SELECT o_orderkey, o_custkey, CAST(row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS BIGINT) AS place FROM orders")
def scan_backward(spark, sf):
    found = ops.ordered_scan(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], False)
    return ops.number_in_order(found, _parts(spark), "place")


@query("SELECT o_orderkey, o_custkey, rid FROM (SELECT *, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS rid FROM orders) WHERE rid IN (7, 77)")
def row_id_read(spark, sf):
    """Rows by the numbers that a load gave them."""
    rows = ops.number_by_key(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], _parts(spark), "rid")
    return ops.point_lookup(rows, ["rid"], [7]).union(ops.point_lookup(rows, ["rid"], [77]))


@query("SELECT c_custkey, c_custkey AS key_c0, nullif(c_nationkey, 3) AS key_c1, c_custkey % 7 AS key_rid FROM customer")
def key_struct(spark, sf):
    """A key of columns by position, the row's id last."""
    rows = _nullable(spark, sf).withColumn("rid", F.col("c_custkey") % 7)
    keyed = ops.make_key(rows, [0, 1], "rid")
    return keyed.select("c_custkey", F.col("key.c_custkey").alias("key_c0"), F.col("key.k").alias("key_c1"), F.col("key.rid").alias("key_rid"))


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer WHERE nullif(c_nationkey, 3) IS NULL")
def filter_is_null(spark, sf):
    return ops.filter_rows(_nullable(spark, sf), F.col("k").isNull())


@query("SELECT o_totalprice AS c0, o_orderkey AS c1, o_custkey AS c2 FROM orders")
def project_reorder(spark, sf):
    return ops.project(table(spark, sf, "orders"), [3, 0, 1])


@query("SELECT o_totalprice AS c0, o_orderkey AS c1, o_orderkey AS c2 FROM orders")
def project_duplicate(spark, sf):
    return ops.project(table(spark, sf, "orders"), [3, 0, 0])


def _nullable(spark, sf) -> DataFrame:
    """Customers with a nullable key."""
    return table(spark, sf, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k"))


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# lookups and ranges


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IS NOT DISTINCT FROM 7")
def point_unique(spark, sf):
    return ops.point_lookup(table(spark, sf, "orders"), ["o_orderkey"], [7]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IS NOT DISTINCT FROM 77")
def point_nonunique(spark, sf):
    return ops.point_lookup(table(spark, sf, "lineitem"), ["l_orderkey"], [77]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer WHERE nullif(c_nationkey, 3) IS NOT DISTINCT FROM NULL")
def point_null(spark, sf):
    return ops.point_lookup(_nullable(spark, sf), ["k"], [None])


def _order_range(name: str, lower: list, upper: list, inclusive: tuple[bool, bool], where: str) -> None:
    def run(spark, sf):
        found = ops.range_scan(table(spark, sf, "orders"), ["o_orderkey"], lower, upper, inclusive)
        return found.select("o_orderkey", "o_totalprice")

    run.__name__ = name
    query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {where}")(run)


_order_range("range_closed", [1000], [5000], (True, True), "o_orderkey >= 1000 AND o_orderkey <= 5000")
_order_range("range_open", [1000], [5000], (False, False), "o_orderkey > 1000 AND o_orderkey < 5000")
_order_range("range_half_low", [1000], [5000], (True, False), "o_orderkey >= 1000 AND o_orderkey < 5000")
_order_range("range_half_high", [1000], [5000], (False, True), "o_orderkey > 1000 AND o_orderkey <= 5000")
_order_range("range_no_lower", [MIN], [5000], (True, True), "o_orderkey <= 5000")
_order_range("range_no_upper", [5000], [MAX], (False, True), "o_orderkey > 5000 OR o_orderkey IS NULL")


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer WHERE nullif(c_nationkey, 3) >= 10 OR nullif(c_nationkey, 3) IS NULL")
def range_unbounded_upper_nulls(spark, sf):
    return ops.range_scan(_nullable(spark, sf), ["k"], [10])


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer WHERE nullif(c_nationkey, 3) > 5 AND nullif(c_nationkey, 3) <= 10")
def range_upper_excludes_nulls(spark, sf):
    return ops.range_scan(_nullable(spark, sf), ["k"], [5], [10], (False, True))


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer WHERE nullif(c_nationkey, 3) IS NOT NULL")
def range_below_null(spark, sf):
    return ops.range_scan(_nullable(spark, sf), ["k"], upper=[None], inclusive=(True, False))


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE (l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber >= 3)) AND (l_orderkey < 200 OR (l_orderkey = 200 AND l_linenumber < 2))""")
def range_composite(spark, sf):
    found = ops.range_scan(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [100, 3], [200, 2], (True, False))
    return found.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey <= 200")
def range_prefix(spark, sf):
    # a bound on a prefix holds all keys that begin with it, whatever its inclusiveness
    found = ops.range_scan(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [100], [200], (False, False))
    return found.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 9000 AND o_totalprice > 200000")
def range_filter(spark, sf):
    found = ops.range_scan(table(spark, sf, "orders"), ["o_orderkey"], [1000], [9000], (True, False), F.col("o_totalprice") > 200000)
    return found.select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey <= 500 ORDER BY o_custkey DESC NULLS FIRST, o_orderkey DESC NULLS FIRST LIMIT 25")
def index_descending_top(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return ops.ordered_scan(orders, ["o_custkey"], False, ["o_orderkey"], upper=[500]).limit(25)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey >= 500 OR o_custkey IS NULL ORDER BY o_custkey NULLS LAST, o_orderkey NULLS LAST LIMIT 25")
def index_ascending_top(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return ops.ordered_scan(orders, ["o_custkey"], True, ["o_orderkey"], lower=[500]).limit(25)


# sorts: a rank proves the order, which rows compared as a set do not show

ORDER_KEYS = ["o_totalprice", "o_orderkey"]


@query("""SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice NULLS LAST, o_orderkey NULLS LAST) AS BIGINT) AS rn
FROM orders ORDER BY rn LIMIT 100""")
def sort_ascending_top(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice", "o_orderkey")
    top = ops.sort_rows(orders, 2, True, SortOptions(top_n=100))
    return ops.with_rank(top, ORDER_KEYS)


@query("""SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey DESC NULLS FIRST) AS BIGINT) AS rn
FROM orders ORDER BY rn LIMIT 100""")
def sort_descending_top(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice", "o_orderkey")
    return ops.with_rank(ops.sort_rows(orders, 2, False, SortOptions(top_n=100)), ORDER_KEYS, False)


@query("""SELECT o_orderpriority, o_totalprice, o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey NULLS LAST) AS BIGINT) AS rn
FROM orders ORDER BY rn LIMIT 50""")
def sort_mixed_top(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    top = ops.sort_rows(orders, 3, [True, False, True], SortOptions(top_n=50))
    return ops.with_rank(top, orders.columns, [True, False, True])


@query("SELECT nullif(c_nationkey, 3) AS k, c_custkey, CAST(row_number() OVER (ORDER BY nullif(c_nationkey, 3) DESC NULLS FIRST, c_custkey) - 1 AS BIGINT) AS seq FROM customer")
def sort_nulls_rank(spark, sf):
    nullable = _nullable(spark, sf).select("k", "c_custkey")
    return ops.number_by_key(nullable, ["k", "c_custkey"], _parts(spark), ascending=[False, True])


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, CAST(rank() OVER (ORDER BY l_orderkey, l_linenumber DESC) AS BIGINT) AS rn FROM lineitem")
def sort_two_keys(spark, sf):
    """A sort by a prefix of the columns; of the places of rows with equal keys the first is told."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    placed = ops.number_in_order(ops.sort_rows(lines, 2, [True, False]), _parts(spark), "at", 1)
    return placed.withColumn("rn", F.min("at").over(Window.partitionBy("l_orderkey", "l_linenumber"))).drop("at")


@query("""SELECT s, p, o_orderkey, CAST(row_number() OVER (ORDER BY s NULLS LAST, p NULLS LAST, o_orderkey) AS BIGINT) AS rn
FROM (SELECT nullif(o_orderstatus, 'F') AS s, nullif(o_orderpriority, '1-URGENT') AS p, o_orderkey FROM orders)""")
def sort_full_rows(spark, sf):
    """A sort by whole rows, two strings with nulls among the columns."""
    orders = table(spark, sf, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("s"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"), "o_orderkey")
    return ops.number_in_order(ops.sort_rows(orders), _parts(spark), "rn", 1)


@query("""SELECT s, p, o_orderkey, CAST(rank() OVER (ORDER BY s DESC NULLS FIRST, p NULLS LAST) AS BIGINT) AS rn
FROM (SELECT nullif(o_orderstatus, 'F') AS s, nullif(o_orderpriority, '1-URGENT') AS p, o_orderkey FROM orders)""")
def sort_prefix_nulls(spark, sf):
    """A sort by two strings with nulls, in both directions; few keys have many rows each, so first places come from an aggregate."""
    orders = table(spark, sf, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("s"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"), "o_orderkey")
    placed = stage(ops.number_in_order(ops.sort_rows(orders, 2, [False, True]), _parts(spark), "at", 1))
    first = placed.groupBy("s", "p").agg(F.min("at").alias("rn")).select(F.col("s").alias("s2"), F.col("p").alias("p2"), "rn")
    return placed.join(first, F.col("s").eqNullSafe(F.col("s2")) & F.col("p").eqNullSafe(F.col("p2"))).select("s", "p", "o_orderkey", "rn")


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM
(SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def distinct_on_key(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return ops.distinct_on(lines, ["l_partkey"])


@query("""SELECT k, c_custkey FROM (SELECT nullif(c_nationkey, 3) AS k, c_custkey, row_number() OVER (PARTITION BY nullif(c_nationkey, 3) ORDER BY c_custkey) AS rn FROM customer) WHERE rn = 1""")
def distinct_on_null_key(spark, sf):
    return ops.distinct_on(_nullable(spark, sf).select("k", "c_custkey"), ["k"])


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM
(SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS rn FROM lineitem)
WHERE rn = 1 ORDER BY l_partkey DESC NULLS FIRST LIMIT 20""")
def distinct_top(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return ops.sort_rows(lines, 1, False, SortOptions(distinct=True, unique=True, top_n=20))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 30")
def unique_top(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return ops.sort_rows(orders, 1, True, SortOptions(unique=True, top_n=30))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, sf):
    return ops.violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT event_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def unique_holds(spark, sf):
    return ops.violations(table(spark, sf, "events"), ["event_id"])


# changes as plans


@query("SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT c_custkey + 100000000, c_custkey FROM customer")
def insert_append(spark, sf):
    more = table(spark, sf, "customer").select((F.col("c_custkey") + 100000000).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"))
    return ops.insert_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), more)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F')")
def delete_where(spark, sf):
    return ops.delete_where(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_where(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ops.update_where(orders, F.col("o_orderstatus") == "O", {"o_orderstatus": F.lit("open"), "o_totalprice": F.lit(0.0)})


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)
UNION ALL SELECT o_orderkey, o_custkey, -1.0 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)""")
def replace_by_key(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    big = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    changed = orders.join(big, "o_orderkey", "left_semi").withColumn("o_totalprice", F.lit(-1.0))
    return ops.replace_rows(orders, changed, "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def delete_by_key(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ops.delete_keys(orders, table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT o_orderkey, 'changed' AS o_orderstatus FROM orders WHERE o_orderkey = 1234")
def delete_others_and_update(spark, sf):
    kept = ops.delete_where(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") != 1234)
    return ops.update_where(kept, F.col("o_orderkey") == 1234, {"o_orderstatus": F.lit("changed")})


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders UNION ALL SELECT c_custkey, NULL, NULL FROM customer")
def null_padding(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.unionByName(ops.pad(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_orderkey")), orders))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS seq FROM events")
def sequence_assign(spark, sf):
    return ops.number_by_key(table(spark, sf, "events").select("event_id"), ["event_id"], _parts(spark))


@query("SELECT o_orderkey, (o_orderkey IS NOT DISTINCT FROM o_custkey) AS same FROM orders")
def row_equality(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ops.same_row([F.col("o_orderkey")], [F.col("o_custkey")]).alias("same"))


@query("""SELECT c_custkey, (nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(c_nationkey % 5, 3)) AND (nullif(c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM nullif(c_mktsegment, 'MACHINERY'))
AND (c_acctbal IS NOT DISTINCT FROM CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END) AS same FROM customer""")
def row_equality_nulls(spark, sf):
    """Whole rows of three columns, nulls on either side."""
    left = [F.nullif(F.col("c_nationkey"), F.lit(3)), F.nullif("c_mktsegment", F.lit("BUILDING")), F.col("c_acctbal")]
    right = [F.nullif(F.col("c_nationkey") % 5, F.lit(3)), F.nullif("c_mktsegment", F.lit("MACHINERY")), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal"))]
    return table(spark, sf, "customer").select("c_custkey", ops.same_row(left, right).alias("same"))


@query("""SELECT 'sort' AS op, count(*) AS n FROM orders WHERE o_orderkey < 0 UNION ALL SELECT 'distinct', count(*) FROM orders WHERE o_orderkey < 0
UNION ALL SELECT 'unique top', count(*) FROM orders WHERE o_orderkey < 0 UNION ALL SELECT 'numbers', count(*) FROM orders WHERE o_orderkey < 0
UNION ALL SELECT 'callback', count(*) FROM orders WHERE o_orderkey < 0 UNION ALL SELECT 'replace', count(*) FROM orders""")
def empty_inputs(spark, sf):
    """How many rows each operator gives of none; replacing by no rows leaves all."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    none = ops.range_scan(orders, ["o_orderkey"], upper=[0], inclusive=(True, False))
    made = {
        "sort": ops.sort_rows(none), "distinct": ops.sort_rows(none, 1, options=SortOptions(distinct=True)), "unique top": ops.sort_rows(none, 1, options=SortOptions(unique=True, top_n=5)),
        "numbers": ops.number_by_key(none, ["o_orderkey"], _parts(spark)), "callback": ops.filter_rows(none, lambda key: key > 0, ["o_orderkey"]), "replace": ops.replace_rows(orders, none, "o_orderkey"),
    }
    found = None
    for name, df in made.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        found = one if found is None else found.union(one)
    return found


# casts


@query("SELECT o_orderkey, CAST((o_orderkey + 128) % 256 - 128 AS TINYINT) AS v FROM orders")
def cast_wrap_byte(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", casts.wrap(F.col("o_orderkey"), "b").alias("v"))


@query("SELECT o_orderkey, CAST((o_orderkey * 40 + 32768) % 65536 - 32768 AS SMALLINT) AS v FROM orders")
def cast_wrap_short(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", casts.wrap(F.col("o_orderkey") * 40, "i").alias("v"))


@query("SELECT o_orderkey, CAST(least(trunc(o_totalprice * 20000), 2147483647) AS INTEGER) AS v FROM orders")
def cast_double_read_as_int(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", casts.read_number(F.col("o_totalprice") * 20000, "d", "I").alias("v"))


@query("SELECT o_orderkey, CAST((CAST(trunc(o_totalprice * 20000) AS BIGINT) + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS v FROM orders")
def cast_double_stored_as_int(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", casts.write_number(F.col("o_totalprice") * 20000, "I", "d").alias("v"))


@query("SELECT c_custkey, coalesce(CAST(nullif(c_nationkey, 3) AS BIGINT), 0) AS n, coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), '0') AS s FROM customer")
def cast_null_reads(spark, sf):
    return _nullable(spark, sf).select("c_custkey", casts.read_number(F.col("k"), "I", "l").alias("n"), casts.number_to_string(F.col("k")).alias("s"))


@query("SELECT o_orderkey, CAST(CAST(o_custkey AS VARCHAR) AS BIGINT) AS v FROM orders")
def cast_string_to_number(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", casts.string_to_number(F.col("o_custkey").cast("string"), "l").alias("v"))


@query("SELECT o_orderkey, printf('%08X', o_orderkey) AS h, o_orderkey AS v FROM orders")
def cast_bytes(spark, sf):
    raw = casts.number_to_bytes(F.col("o_orderkey"), "I")
    return table(spark, sf, "orders").select("o_orderkey", F.hex(raw).alias("h"), casts.bytes_to_number(casts.number_to_bytes(F.col("o_orderkey"), "l"), "l").alias("v"))


@query("SELECT doc_id, octet_length(encode(text)) AS n FROM documents")
def byte_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", casts.byte_length(F.col("text")).alias("n"))


@query("SELECT doc_id, substr(hex(encode(text)), 7, 10) AS part, octet_length(encode(text)) AS n FROM documents")
def byte_slice(spark, sf):
    """Five bytes from the fourth on, fewer where the text ends; characters may be cut."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.hex(casts.byte_slice(F.col("text"), 3, 5)).alias("part"), casts.byte_length(F.col("text")).alias("n"))


@query("SELECT c_custkey, concat_ws(',', CAST(c_custkey AS VARCHAR), coalesce(CAST(nullif(c_nationkey, 3) AS VARCHAR), 'null') || ' DESC') AS t FROM customer")
def row_text(spark, sf):
    return _nullable(spark, sf).select("c_custkey", casts.row_text(["c_custkey", "k"], [True, False]).alias("t"))


# changes one after another: each version is a table of its own, so what was read before stays as it was


@query("SELECT o_orderkey AS c0, o_custkey AS c1, CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE o_totalprice END AS c2 FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT c_custkey + 100000000, c_custkey, c_acctbal FROM customer")
def store_changes(spark, sf):
    """Insert, remove, update and insert again."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("c0"), F.col("o_custkey").alias("c1"), F.col("o_totalprice").alias("c2"), F.col("o_orderstatus").alias("c3"))
    first = stage(rows)
    kept = ops.update_where(ops.delete_where(first, F.col("c3") == "P"), F.col("c3") == "O", {"c2": F.lit(0.0)})
    more = table(spark, sf, "customer").select((F.col("c_custkey") + 100000000).alias("c0"), F.col("c_custkey").alias("c1"), F.col("c_acctbal").alias("c2"))
    return ops.insert_rows(kept, ops.pad(more, kept)).select("c0", "c1", "c2")


@query("SELECT o_orderkey AS c0, o_totalprice AS c1 FROM orders")
def snapshot_visibility(spark, sf):
    """A version is read as it was though a later one, made from it, lacks most of its rows."""
    seen = stage(table(spark, sf, "orders").select(F.col("o_orderkey").alias("c0"), F.col("o_totalprice").alias("c1")))
    later = stage(ops.delete_where(seen, F.col("c0") > 100))
    return seen.join(later.select("c0"), "c0", "left_semi").unionByName(ops.delete_keys(seen, later, "c0"))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS details, CAST(sum(l_linenumber) AS BIGINT) AS summary FROM lineitem")
def isolation_sum(spark, sf):
    """Details and their sum change together each time, so that every version has them equal."""
    lines = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("n"))
    details, summary = lines.limit(0), lines.agg(F.lit(0).cast("long").alias("summary"))
    for part in (F.col("n") % 2 == 0, F.col("n") % 2 == 1):
        chosen = lines.where(part)
        details = ops.insert_rows(details, chosen)
        summary = stage(summary.crossJoin(chosen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("more"))).select((F.col("summary") + F.col("more")).alias("summary")))  # one row each
    return details.agg(F.sum("n").alias("details")).crossJoin(summary)


@query("SELECT o_custkey AS c0, o_orderkey AS c1 FROM orders WHERE o_custkey > 100 AND o_custkey <= 300")
def index_cursor_range(spark, sf):
    rows = stage(table(spark, sf, "orders").select(F.col("o_custkey").alias("c0"), F.col("o_orderkey").alias("c1")))
    return ops.ordered_scan(rows, ["c0"], lower=[100], upper=[300], inclusive=(False, True))


FLAGSHIP = "SELECT o_totalprice, o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 5000 ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10"


@query(FLAGSHIP)
def flagship(spark, sf):
    """Range, projection, mixed-direction sort and top-N in one plan."""
    found = ops.range_scan(table(spark, sf, "orders"), ["o_orderkey"], [1000], [5000], (True, False))
    picked = ops.project(found, [3, 0, 1], ["o_totalprice", "o_orderkey", "o_custkey"])
    return ops.sort_rows(picked, 2, [False, True], SortOptions(top_n=10))
