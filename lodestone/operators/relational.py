"""The relational operators, each a plan on the DataFrame that it is given."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodestone.errors import UniqueConstraintError
from lodestone.functions.ordering import equals, terms, within
from lodestone.sources.staging import stage


@dataclass(frozen=True)
class SortOptions:
    """What a sort does besides ordering; distinct goes before unique, and top_n (0: all) comes last."""

    distinct: bool = False
    unique: bool = False
    top_n: int = 0


def names(df: DataFrame, positions: Sequence[int]) -> list[str]:
    return [df.columns[p] for p in positions]


def project(df: DataFrame, positions: Sequence[int], aliases: Sequence[str] | None = None) -> DataFrame:
    """Columns by position, in that order and as often as they are named."""
    aliases = aliases or [f"c{n}" for n in range(len(positions))]
    return df.select(*(F.col(f"`{df.columns[p]}`").alias(a) for p, a in zip(positions, aliases, strict=True)))


def make_key(df: DataFrame, positions: Sequence[int], rid: str | None = None, name: str = "key") -> DataFrame:
    """``df`` with a struct of key columns, and the row's id as the last if it is asked for."""
    return df.withColumn(name, F.struct(*names(df, positions), *([rid] if rid else [])))


def filter_rows(df: DataFrame, passes: Column | Callable | None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that pass a condition.

    A Python function gets ``columns`` (default: all) as pandas Series, a batch of rows at a
    time, and returns a Series of booleans, where null does not pass. Only these columns go
    to Python; a condition given as a Column stays in the plan and may reach the scan.
    """
    if passes is None:
        return df
    if callable(passes) and not isinstance(passes, Column):

        def test(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(passes(*(rows[c] for c in rows))).eq(True).fillna(False).astype(bool)

        return df.filter(F.pandas_udf(test, BooleanType())(F.struct(*(F.col(f"`{c}`") for c in columns or df.columns))))
    return df.filter(passes)


def point_lookup(df: DataFrame, keys: Sequence[str], values: Sequence, passes: Column | None = None) -> DataFrame:
    """Rows with exactly these key values; null finds null."""
    found = F.lit(True)
    for k, v in zip(keys, values, strict=True):
        found = found & equals(F.col(k), v)
    return filter_rows(df.filter(found), passes)


def range_scan(df: DataFrame, keys: Sequence[str], lower: Sequence = (), upper: Sequence = (), inclusive: tuple[bool, bool] = (True, True), passes: Column | None = None) -> DataFrame:
    """Rows whose composite key lies between the bounds, in no order."""
    return filter_rows(df.filter(within([F.col(k) for k in keys], lower, upper, inclusive)), passes)


def ordered_scan(df: DataFrame, keys: Sequence[str], forward: bool = True, tie: Sequence[str] = (), **bounds) -> DataFrame:
    """:func:`range_scan` in the order of the key, or against it."""
    return range_scan(df, keys, **bounds).orderBy(*terms([*keys, *tie], forward))


def distinct_on(df: DataFrame, keys: Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """The first row of each key, by the other columns in order; nulls make one key.

    Rows are reduced in each partition before they meet: the minimum of a struct in null-high
    order is an aggregate, so a key that many rows have is not sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    held = F.struct(*(x for c in rest for x in (F.col(c).isNull().alias(f"{c}__null"), F.col(c).alias(c))))
    least = df.groupBy(*keys).agg(F.min(held).alias("_least"))
    return least.select(*(F.col(c) if c in keys else F.col(f"_least.{c}").alias(c) for c in df.columns))


def violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with the count as ``n``; nulls are equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, after a job has found no key twice."""
    if (found := violations(df, keys).head(1)):
        raise UniqueConstraintError(f"more than one row has the key {tuple(found[0])[:-1]}")
    return df


def sort_rows(df: DataFrame, n_keys: int = 0, ascending: bool | Sequence[bool] = True, options: SortOptions | None = None) -> DataFrame:
    """Rows ordered by the first ``n_keys`` columns (0: by all), each ascending or descending."""
    options = options or SortOptions()
    keys = df.columns[: n_keys or len(df.columns)]
    if options.distinct:
        df = distinct_on(df, keys)
    elif options.unique:
        df = assert_unique(df, keys)
    df = df.orderBy(*terms(keys, ascending))
    return df.limit(options.top_n) if options.top_n else df


def with_rank(df: DataFrame, keys: Sequence[str], ascending: bool | Sequence[bool] = True, name: str = "rn") -> DataFrame:
    """``df`` with the place (from 1) of each row in a small ordered result, such as a top-N."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*terms(keys, ascending))).cast("long"))


def number_rows(df: DataFrame, start: int = 0, name: str = "_rid") -> DataFrame:
    """``df`` with gapless numbers from ``start`` in its own order of partitions and rows.

    Numbers are a partition's base, a prefix sum over the partitions' counts, and a place in
    the partition; ``df`` is computed twice and must give the same rows in the same order, as
    files do.
    """
    part, place = F.shiftright(F.monotonically_increasing_id(), 33), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    counted = df.select(part.alias("_part")).groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = counted.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = df.withColumn("_part", part).withColumn("_place", place)
    return placed.join(F.broadcast(bases), "_part").select(*df.columns, (F.col("_base") + F.col("_place") + start).alias(name))


def number_by_key(df: DataFrame, keys: Sequence[str], parts: int, name: str = "seq", start: int = 0, ascending: bool | Sequence[bool] = True) -> DataFrame:
    """``df`` with gapless numbers from ``start`` in key order, without one task that sees all rows."""
    spread = df.repartitionByRange(parts, *terms(keys, ascending)).sortWithinPartitions(*terms(keys, ascending)).withColumn("_part", F.spark_partition_id())
    fixed = stage(spread)
    # the place in a range, and the base of the range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*terms(keys, ascending))) - 1
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    bases = fixed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return fixed.withColumn("_place", place).join(F.broadcast(bases), "_part").select(*df.columns, (F.col("_base") + F.col("_place") + start).cast("long").alias(name))


def number_in_order(df: DataFrame, parts: int, name: str = "seq", start: int = 0) -> DataFrame:
    """``df`` with gapless numbers from ``start`` in the order that its rows have now, such as a sort's."""
    fixed = stage(df.withColumn("_at", F.monotonically_increasing_id()))
    return number_by_key(fixed, ["_at"], parts, name, start).drop("_at")


def pad(df: DataFrame, like: DataFrame) -> DataFrame:
    """Rows of a shorter table as rows of ``like``: columns that are missing become null."""
    return like.limit(0).unionByName(df, allowMissingColumns=True)


def same_row(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality of whole rows."""
    return F.struct(*left).eqNullSafe(F.struct(*right))


def insert_rows(df: DataFrame, more: DataFrame) -> DataFrame:
    return df.unionByName(more)


def delete_where(df: DataFrame, passes: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return df.filter(~F.coalesce(passes, F.lit(False)))


def update_where(df: DataFrame, passes: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with new values where the condition is true."""
    hit = F.coalesce(passes, F.lit(False))
    kinds = dict(df.dtypes)
    return df.select(*(F.when(hit, values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def delete_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti").select(*df.columns)


def replace_rows(df: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Whole-row replacement by key."""
    return delete_keys(df, changed, key).unionByName(changed.select(*df.columns))
