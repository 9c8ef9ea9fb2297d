"""One order for all keys: null is greater than every value, and descending turns that round.

Bounds of ranges may also be MIN, below everything, and MAX, above everything and null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class _Sentinel:
    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return self.name


MIN, MAX = _Sentinel("MIN"), _Sentinel("MAX")


def nl(column: str | Column, ascending: bool = True) -> Column:
    """An ordering term with null as the greatest value."""
    c = F.col(column) if isinstance(column, str) else column
    return c.asc_nulls_last() if ascending else c.desc_nulls_first()


def terms(columns: Sequence[str], ascending: bool | Sequence[bool] = True) -> list[Column]:
    flags = [ascending] * len(columns) if isinstance(ascending, bool) else list(ascending)
    return [nl(c, a) for c, a in zip(columns, flags + [True] * (len(columns) - len(flags)), strict=True)]


def above(key: Column, bound) -> Column:
    """key > bound"""
    if bound is MIN:
        return F.lit(True)
    if bound is MAX or bound is None:
        return F.lit(False)
    return (key > bound) | key.isNull()


def below(key: Column, bound) -> Column:
    """key < bound; never null"""
    if bound is MAX:
        return F.lit(True)
    if bound is MIN:
        return F.lit(False)
    return key.isNotNull() if bound is None else key.isNotNull() & (key < bound)


def equals(key: Column, bound) -> Column:
    if bound is MIN or bound is MAX:
        return F.lit(False)
    return key.isNull() if bound is None else key.eqNullSafe(F.lit(bound))


def _beyond(keys: Sequence[Column], bounds: Sequence, inclusive: bool, side) -> Column:
    if not keys:
        return F.lit(inclusive)
    first = side(keys[0], bounds[0])
    if bounds[0] is MIN or bounds[0] is MAX:
        return first  # nothing equals a sentinel
    if len(keys) == 1:
        return first | equals(keys[0], bounds[0]) if inclusive else first
    return first | (equals(keys[0], bounds[0]) & _beyond(keys[1:], bounds[1:], inclusive, side))


def lower_bound(keys: Sequence[Column], bounds: Sequence, inclusive: bool = True) -> Column:
    """Whether composite ``keys`` lie above ``bounds``; fewer bounds than keys bound a prefix."""
    bounds = [*bounds, *[MIN] * (len(keys) - len(bounds))]
    whole = _beyond(keys, bounds, inclusive, above)
    if len(keys) > 1 and bounds[0] not in (MIN, MAX, None):  # a condition on one column reaches the scan
        return ((keys[0] >= bounds[0]) | keys[0].isNull()) & whole
    return whole


def upper_bound(keys: Sequence[Column], bounds: Sequence, inclusive: bool = True) -> Column:
    """Whether composite ``keys`` lie below ``bounds``."""
    bounds = [*bounds, *[MAX] * (len(keys) - len(bounds))]
    whole = _beyond(keys, bounds, inclusive, below)
    if len(keys) > 1 and bounds[0] not in (MIN, MAX, None):
        return (keys[0] <= bounds[0]) & whole
    return whole


def within(keys: Sequence[Column], lower: Sequence = (), upper: Sequence = (), inclusive: tuple[bool, bool] = (True, True)) -> Column:
    """The range between two composite bounds; without bounds everything, null keys included."""
    return lower_bound(keys, lower, inclusive[0]) & upper_bound(keys, upper, inclusive[1])
