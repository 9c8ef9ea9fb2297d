"""Casts, orderings, bounds and sorts against small models in Python."""

import itertools
import math
import os
import random
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from lodestone.errors import TypeMismatchError, UniqueConstraintError
from lodestone.functions import casts
from lodestone.functions.ordering import MAX, MIN, terms, within
from lodestone.functions.types import parse_types, too_long, type_codes
from lodestone.operators import relational as ops
from lodestone.operators.relational import SortOptions
from lodestone.sources.memory import empty_source, rows_source
from lodestone.streaming.rows import RowStream


def rank(v):
    return (0, 0) if v is MIN else (3, 0) if v is MAX else (2, 0) if v is None else (1, v)


def test_type_codes():
    schema = parse_types("sSbiIldaA")
    assert type_codes(schema) == "sSbiIldaA" and schema[0].metadata["max_bytes"] == 255
    for bad in ("f", "", "I" * 128, "Ix"):
        with pytest.raises(TypeMismatchError):
            parse_types(bad)


def test_too_long_counts_bytes(spark):
    df = spark.createDataFrame([("é" * 127, ""), ("é" * 128, ""), (None, "x" * 300)], parse_types("sS"))
    assert [r[0] for r in df.select(too_long(df.schema)).collect()] == [False, True, False]


INTS = [None, 0, 1, -1, 127, 128, -129, 32768, 2**31 - 1, 2**31, -(2**31) - 1, 2**63 - 1, -(2**63)]


@pytest.mark.parametrize("code", "biIl")
def test_integers_wrap(spark, code):
    bits = casts.WIDTH[code]
    df = spark.createDataFrame([(v,) for v in INTS], "v long")
    got = [tuple(r) for r in df.select(casts.wrap(F.col("v"), code), casts.read_number(F.col("v"), "l", code), casts.write_number(F.col("v"), code, "l")).collect()]
    low = lambda v: v if v is None else (v + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)
    assert got == [(low(v), low(v) or 0, low(v)) for v in INTS]


DOUBLES = [None, 0.0, -0.5, 1.9, -1.9, 300.7, 2.0**31, 3.9e10, -3.9e10, 1e300, -1e300, math.nan, math.inf, -math.inf]


def held(v, bits):
    if math.isnan(v):
        return 0
    return int(max(-(2 ** (bits - 1)), min(2 ** (bits - 1) - 1, math.trunc(v) if math.isfinite(v) else math.copysign(2**70, v))))


@pytest.mark.parametrize("code", "biIl")
def test_doubles_are_cut_held_and_wrapped(spark, code):
    bits = casts.WIDTH[code]
    df = spark.createDataFrame([(v,) for v in DOUBLES], "v double")
    got = [tuple(r) for r in df.select(casts.read_number(F.col("v"), "d", code), casts.write_number(F.col("v"), code, "d")).collect()]
    low = lambda v: (v + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)
    assert got == [(0 if v is None else low(held(v, 64 if code == "l" else 32)), None if v is None else low(held(v, 64))) for v in DOUBLES]


def test_strings_and_bytes(spark):
    df = spark.createDataFrame([("12",), (None,)], "s string")
    assert [tuple(r) for r in df.select(casts.read_string(F.col("s")), casts.string_to_number(F.col("s"), "I"), casts.string_as_number(F.col("s"), "I", strict=False), casts.read_bytes(F.col("s"))).collect()] == [("12", 12, 0, bytearray(b"12")), ("", None, 0, bytearray())]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("x1",)], "s string").select(casts.string_to_number(F.col("s"), "l")).collect()
    for code in "biIl":
        top = 1 << casts.WIDTH[code] - 1
        df = spark.createDataFrame([(v,) for v in (0, 1, -1, top - 1, -top)], "v long")
        for v, raw, back in df.select("v", casts.number_to_bytes(F.col("v"), code).alias("raw"), casts.bytes_to_number(casts.number_to_bytes(F.col("v"), code), code)).collect():
            assert bytes(raw) == v.to_bytes(casts.WIDTH[code] // 8, "big", signed=True) and back == v
    assert spark.range(1).select(casts.bytes_to_number(F.lit(b""), "I"), casts.byte_slice(F.lit(b"abcdef"), 2, 3), casts.byte_length(F.lit("é"))).first()[:] == (None, bytearray(b"cde"), 2)


def test_bounds_against_a_model(spark):
    keys = list(itertools.product([None, 0, 1, 2, 3], repeat=2))
    df = spark.createDataFrame([(n, *k) for n, k in enumerate(keys)], "n int, a int, b int")
    cases = list(itertools.product(itertools.product([MIN, None, 1, 2, MAX], repeat=2), (True, False)))
    columns = []
    for n, (bound, inclusive) in enumerate(cases):
        columns.append(within([F.col("a"), F.col("b")], lower=bound, inclusive=(inclusive, True)).alias(f"low{n}"))
        columns.append(within([F.col("a"), F.col("b")], upper=bound, inclusive=(True, inclusive)).alias(f"up{n}"))
    for row in df.select("n", *columns).collect():
        key = [rank(v) for v in keys[row.n]]
        for n, (bound, inclusive) in enumerate(cases):
            at = [rank(v) for v in bound]
            assert bool(row[f"low{n}"]) == (key > at or inclusive and key == at), (keys[row.n], bound, inclusive)
            assert bool(row[f"up{n}"]) == (key < at or inclusive and key == at), (keys[row.n], bound, inclusive)


def test_order_against_a_model(spark):
    rows = [(a, b) for a in (None, 1.5, -2.0, -7.0, 0.0, math.inf) for b in (None, "", "a", "ab", "z", "é")]
    df = spark.createDataFrame(rows, "a double, b string")
    for up in itertools.product([True, False], repeat=2):
        def compare(x, y, up=up):
            for p, q, asc in zip(x, y, up, strict=True):
                p, q = rank(p), rank(q)
                if p != q:
                    return (-1 if p < q else 1) * (1 if asc else -1)
            return 0

        assert [tuple(r) for r in df.orderBy(*terms(["a", "b"], list(up))).collect()] == sorted(rows, key=cmp_to_key(compare))


def test_ranges_reach_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = ops.range_scan(df, ["k", "v"], [10, 3], [20]).select("k", "v")._jdf.queryExecution().toString()
    assert "PushedFilters: []" not in plan and "PushedFilters: [" in plan and "GreaterThanOrEqual(k,10)" in plan


def test_range_matrix(spark):
    df = spark.range(5000).select(F.col("id").cast("int").alias("k")).cache()
    rng = random.Random(5)
    for _ in range(4):
        a = rng.randrange(4000)
        for lo, hi in itertools.product((True, False), repeat=2):
            want = [k for k in range(5000) if (k >= a if lo else k > a) and (k <= a + 500 if hi else k < a + 500)]
            for up in (True, False):
                got = [r.k for r in ops.ordered_scan(df, ["k"], up, lower=[a], upper=[a + 500], inclusive=(lo, hi)).collect()]
                assert got == (want if up else want[::-1])
    df.unpersist()


def test_sorts(spark):
    rows = [("D1", "A", "K2"), ("D2", "A", "K2"), ("D3", "A", "K1")]
    df = ops.project(rows_source(spark, rows, "sss"), [1, 2, 0])
    assert [tuple(r) for r in ops.sort_rows(df, 2, options=SortOptions(distinct=True)).collect()] == [("A", "K1", "D3"), ("A", "K2", "D1")]
    with pytest.raises(UniqueConstraintError):
        ops.sort_rows(df, 2, options=SortOptions(unique=True))
    assert ops.sort_rows(df, 2, options=SortOptions(distinct=True, unique=True, top_n=1)).collect()[0].c2 == "D3"
    assert len(ops.sort_rows(df, 2, options=SortOptions(top_n=2)).collect()) == 2
    with pytest.raises(UniqueConstraintError):  # the assertion covers the whole input, not the rows that stay
        ops.sort_rows(df, 2, options=SortOptions(unique=True, top_n=1))
    two = rows_source(spark, [("W", None), ("", "W"), ("W", ""), (None, None), ("W", "K")], "ss")
    assert [tuple(r) for r in ops.sort_rows(two).collect()] == [("", "W"), ("W", ""), ("W", "K"), ("W", None), (None, None)]
    assert ops.sort_rows(two, ascending=False).first()[:] == (None, None)


def test_many_duplicates(spark):
    df = spark.range(100_000).select((F.col("id") % 1000).cast("int").alias("c0"), (-F.col("id")).alias("c1"))
    got = ops.sort_rows(df, 1, options=SortOptions(distinct=True)).collect()
    assert [r.c0 for r in got] == list(range(1000)) and got[5].c1 == -99005
    with pytest.raises(UniqueConstraintError):
        ops.sort_rows(df, 1, options=SortOptions(unique=True))


def test_numbers_in_key_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(5)
    assert sorted((r.k, r.seq) for r in ops.number_by_key(df, ["k"], 7).collect()) == [(k, k) for k in range(1000)]


def test_empty_inputs(spark):
    none = empty_source(spark, "Is")
    for df in (ops.sort_rows(none), ops.sort_rows(none, 1, options=SortOptions(True, True, 3)), ops.distinct_on(none, ["c0"]), ops.range_scan(none, ["c0"], [1], [2]), ops.point_lookup(none, ["c0"], [None]), ops.violations(none, ["c0"]), ops.number_by_key(none, ["c0"], 3), ops.update_where(none, F.col("c0") > 1, {"c1": F.lit("x")}), ops.pad(none, none)):
        assert df.collect() == []
    stream = RowStream(none, ["c0"])
    assert stream.fetch_next() is None and stream.fetch_prev() is None


def test_changes_and_predicates(spark):
    df = rows_source(spark, [(1, "a"), (None, "b"), (3,)], "Is")
    assert sorted(r.c1 or "" for r in ops.delete_where(df, F.col("c0") > 2).collect()) == ["a", "b"]
    assert [tuple(r) for r in ops.filter_rows(df, lambda c0, c1: (c0 == 3) | (c1 == "b")).collect()] == [(None, "b"), (3, None)]
    assert [r.c0 for r in ops.filter_rows(df, lambda c0: c0 < 3, ["c0"]).collect()] == [1]
    assert [r.key._rid if "_rid" in r.key else r.key[0] for r in ops.make_key(df, [0]).where("c0 = 1").collect()] == [1]
    got = ops.replace_rows(df, rows_source(spark, [(1, "new")], "Is"), "c0")
    assert {r.c1 for r in got.collect()} == {"new", "b", None}
    assert [r[0] for r in df.where("c0 = 1").select(casts.row_text(["c0", "c1"], [True, False])).collect()] == ["1,a DESC"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_uniqueness_fails_over_many_rows_and_the_sort_may_be_tried_again(spark):
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    with pytest.raises(UniqueConstraintError):
        ops.sort_rows(lines, 1, options=SortOptions(unique=True))
    once = ops.sort_rows(lines, 1, options=SortOptions(distinct=True, unique=True))
    assert once.count() == lines.select("l_orderkey").distinct().count() and once.filter("l_orderkey is null").isEmpty()


def test_only_the_columns_that_a_function_reads_go_to_it(spark, tmp_path):
    spark.range(20).selectExpr("id as a", "id * 2 as b", "cast(id as string) as c").write.parquet(f"{tmp_path}/t")
    found = ops.filter_rows(spark.read.parquet(f"{tmp_path}/t"), lambda a: a > 17, ["a"]).select("b")
    assert sorted(r.b for r in found.collect()) == [36, 38]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:bigint,b:bigint>" in plan and "ArrowEvalPython" in plan
