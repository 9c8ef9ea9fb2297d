"""Pull access to a DataFrame in a fixed order, forwards and backwards, repeatable."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lodestone.functions.ordering import lower_bound, terms, upper_bound


class RowStream:
    """Rows of ``df`` by the order of ``keys``, which together identify a row.

    Rows come to the driver a partition at a time. A change of direction, or a condition,
    starts a new scan from the key of the row last fetched, so nothing is kept but that row.
    Before the first row and after the last are positions of their own: at an end further
    fetches give nothing until the direction changes or the stream is rewound.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], prefetch: bool = True):
        self.df, self.keys, self.prefetch = df, list(keys), prefetch
        self.rewind()

    def _start(self, row: Row | None, end: int) -> None:
        self.row, self.end = row, end  # end: -1 before the first row, 1 after the last, 0 at a row
        self.scan: tuple | None = None
        self.rows: Iterator[Row] = iter(())

    def rewind(self) -> None:
        """Go before the first row."""
        self._start(None, -1)

    def forward(self) -> None:
        """Go after the last row."""
        self._start(None, 1)

    close = rewind

    def _fetch(self, up: bool, passes: Column | Callable | None) -> Row | None:
        if self.end == (1 if up else -1):
            return None
        condition = passes if isinstance(passes, Column) else None
        if self.scan is None or self.scan[0] != up or self.scan[1] is not condition:
            found = self.df
            if self.end == 0:
                keys, at = [F.col(k) for k in self.keys], [self.row[k] for k in self.keys]
                found = found.filter(lower_bound(keys, at, False) if up else upper_bound(keys, at, False))
            if condition is not None:
                found = found.filter(condition)
            self.rows = found.orderBy(*terms(self.keys, up)).toLocalIterator(prefetchPartitions=self.prefetch)
            self.scan = (up, condition)
        for row in self.rows:
            self.row, self.end = row, 0
            if passes is None or condition is not None or passes(row):
                return row
        self._start(None, 1 if up else -1)
        return None

    def fetch_next(self, passes: Column | Callable | None = None) -> Row | None:
        """The next row (that passes), or None at the end."""
        return self._fetch(True, passes)

    def fetch_prev(self, passes: Column | Callable | None = None) -> Row | None:
        return self._fetch(False, passes)

    def __iter__(self) -> Iterator[Row]:
        while (row := self.fetch_next()) is not None:
            yield row
