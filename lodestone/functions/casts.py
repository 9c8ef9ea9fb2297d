"""Reading and writing a column's value as another type.

Numbers widen and narrow as two's complement integers do: a value stored into a narrower
column keeps its low bits, a double is cut towards zero and held within the range of the
integer that it is read as. Everything is a Column expression and holds under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = {"b": 8, "i": 16, "I": 32, "l": 64}
NAMES = {"b": "tinyint", "i": "smallint", "I": "int", "l": "bigint"}


def wrap(value: Column, code: str) -> Column:
    """The low bits of a whole number, as an integer of the code's width."""
    bits = WIDTH[code]
    if bits == 64:
        return value.cast("bigint")
    half = 1 << (bits - 1)
    low = F.pmod(F.pmod(value.cast("bigint"), F.lit(half * 2)) + half, F.lit(half * 2)) - half
    return low.cast(NAMES[code])


def cut(value: Column, bits: int) -> Column:
    """A double cut towards zero and held within integers of ``bits`` bits; NaN becomes 0."""
    top = (1 << (bits - 1)) - 1
    low, high = F.lit(float(-top - 1)), F.lit(float(top + 1))
    held = F.when(value >= high, F.lit(top)).when(value <= low, F.lit(-top - 1))
    return F.when(F.isnan(value), F.lit(0)).otherwise(F.coalesce(held, F.when((value < high) & (value > low) & ~F.isnan(value), value).cast("bigint"))).cast("bigint")


def read_number(value: Column, code: str, as_code: str) -> Column:
    """A number column of type ``code`` read as another number; null reads as 0."""
    if as_code == "d":
        return F.coalesce(value.cast("double"), F.lit(0.0))
    if code == "d":
        whole = cut(value, 64 if as_code == "l" else 32)
        return F.coalesce(wrap(whole, as_code), F.lit(0).cast(NAMES[as_code]))
    return F.coalesce(wrap(value, as_code), F.lit(0).cast(NAMES[as_code]))


def write_number(value: Column, code: str, from_code: str) -> Column:
    """A number of type ``from_code`` as it is stored in a column of type ``code``; null stays null."""
    if code == "d":
        return value.cast("double")
    return wrap(cut(value, 64) if from_code == "d" else value, code)


def number_to_string(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("0"))


def string_to_number(value: Column, code: str) -> Column:
    """Parses a string; what is no number of that type fails the job."""
    return value.cast("double" if code == "d" else NAMES[code])


def read_string(value: Column) -> Column:
    """A string or byte string column read as a string; null reads as empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


def read_bytes(value: Column) -> Column:
    return F.coalesce(value.cast("binary"), F.lit(b""))


def string_as_number(value: Column, code: str, strict: bool = True) -> Column:
    """A string column read as a number: parsed, or 0 as such a read always gives if not ``strict``."""
    if strict:
        return string_to_number(value, code)
    return F.lit(0).cast("double" if code == "d" else NAMES[code])


def number_to_bytes(value: Column, code: str) -> Column:
    """Big-endian bytes of an integer, as many as its type is wide."""
    digits = WIDTH[code] // 4
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("bigint")), 16, "0"), 17 - digits, digits))


def bytes_to_number(value: Column, code: str) -> Column:
    """The integer that big-endian bytes give; empty bytes give null."""
    digits = WIDTH[code] // 4
    text = F.right(F.hex(value), F.lit(digits))
    whole = F.conv(text, 16, -10).cast("decimal(20,0)") if WIDTH[code] == 64 else F.conv(text, 16, 10).cast("bigint")
    return F.when(F.length(value) > 0, whole.cast("bigint") if WIDTH[code] == 64 else wrap(whole, code))


def byte_length(value: Column) -> Column:
    return F.octet_length(value).cast("bigint")


def byte_slice(value: Column, start: int, length: int) -> Column:
    """``length`` bytes from ``start``, counted from 0."""
    return F.substring(value.cast("binary"), start + 1, length)


def row_text(columns: list[str], directions: list[bool] | None = None) -> Column:
    """A row as text: values joined by commas, null as ``null``, descending columns marked."""
    parts = [F.concat(F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit("" if asc else " DESC")) for c, asc in zip(columns, directions or [True] * len(columns), strict=True)]
    return F.concat_ws(",", *parts)


#: Types whose values are numbers, by code.
NUMBERS: dict[str, T.DataType] = {"b": T.ByteType(), "i": T.ShortType(), "I": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType()}
