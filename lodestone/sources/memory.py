"""Rows from the driver's memory, and none at all."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.types import check_row, parse_types


def rows_source(spark: SparkSession, rows: Iterable[tuple], codes: str) -> DataFrame:
    """A DataFrame of Python rows with the types that the codes name; short rows end in nulls."""
    schema = parse_types(codes)
    return spark.createDataFrame([check_row(tuple(r), schema) for r in rows], schema)


def empty_source(spark: SparkSession, codes: str) -> DataFrame:
    return spark.createDataFrame([], parse_types(codes))
