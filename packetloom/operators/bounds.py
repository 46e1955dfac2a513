"""Bounds for the first rows of an order, found by counting.

To take the first n rows of a large table, most of it need not be ordered. Rows are
counted by cells of the first order column; the cell that holds rank n is cut into
finer ones until it is small, or has one value, when the next column is cut. The
values met there bound the n rows, and the bound is a plain comparison that a scan
can push down.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 4096
#: rows of a cell that is not cut further
SMALL = 10_000
_ROUNDS = 6
_EPOCH = dt.datetime(1970, 1, 1)


class _Axis:
    """An order column as numbers that never decrease along it.

    ``value`` is what is collected of the column, ``typed`` turns it into a literal
    of the column's type again, ``number`` may lose detail (of texts, all but a few
    bytes after what ``low`` and ``high`` share).
    """

    def __init__(self, name: str, kind: T.DataType):
        self.name, self.kind = name, kind
        column = F.col(name)
        if isinstance(kind, T.TimestampType):
            self.value = F.unix_micros(column)
        elif isinstance(kind, T.TimestampNTZType):
            self.value = F.timestamp_diff("MICROSECOND", F.lit(str(_EPOCH)).cast(kind), column)
        elif isinstance(kind, T.DateType):
            self.value = F.unix_date(column)
        else:
            self.value = column

    @staticmethod
    def fits(kind: T.DataType) -> bool:
        plain = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
        return isinstance(kind, plain)

    def typed(self, value) -> Column:
        if isinstance(self.kind, T.TimestampType):
            return F.timestamp_micros(F.lit(value).cast("long"))
        if isinstance(self.kind, T.TimestampNTZType):
            return F.lit(str(_EPOCH + dt.timedelta(microseconds=value))).cast(self.kind)
        if isinstance(self.kind, T.DateType):
            return F.date_from_unix_date(F.lit(value).cast("int"))
        return F.lit(value).cast(self.kind)

    def number(self, low, high) -> Column:
        if not isinstance(self.kind, T.StringType):
            return self.value.cast("double")
        a, b = low.encode(), high.encode()
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        head = F.substring(F.col(self.name).cast("binary"), same + 1, 6)
        return F.conv(F.rpad(F.hex(head), F.lit(12), F.lit("0")), 16, 10).cast("double")

    def finite(self) -> Column:
        if isinstance(self.kind, (T.DoubleType, T.FloatType)):
            return ~F.isnan(self.value) & (F.abs(self.value) < float("inf"))
        return self.value.isNotNull()


def _cells(rows: DataFrame, axis: _Axis) -> list:
    """(rows, smallest, largest) of every cell with rows, ascending; at most
    ``CELLS`` + 4. Values that are not finite have cells of their own."""
    ends = rows.filter(axis.finite()).agg(F.min(axis.value), F.max(axis.value)).first()
    x = axis.value
    if ends[0] is None:
        cell = F.lit(0)
    else:
        number = axis.number(*ends)
        low, high = rows.filter(axis.finite()).agg(F.min(number), F.max(number)).first()
        width = (high - low) / CELLS or 1.0
        cell = F.least(F.floor((number - low) / width), F.lit(CELLS - 1)).cast("long")
    if isinstance(axis.kind, (T.DoubleType, T.FloatType)):
        cell = (
            F.when(F.isnan(x), CELLS + 1)
            .when(x == float("inf"), CELLS)
            .when(x == float("-inf"), -1)
            .otherwise(cell)
        )
    counted = rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)), F.min(x), F.max(x))
    return [tuple(r)[1:] for r in sorted(counted.collect(), key=lambda r: r[0])]


def leading_bound(df: DataFrame, order: Sequence[str], n: int, descending: bool = False) -> Column | None:
    """A condition that the first ``n`` rows along ``order`` meet, and few others: the
    rest of one cell, and rows that equal the last in all columns that could be cut.
    None if all rows may be among them.

    NULL comes first ascending, last descending. A pass over the order columns counts
    one round of cells; nothing but their counts and ends is collected.
    """
    names = list(order)
    equal: Column = F.lit(True)
    bound: Column = F.lit(False)
    left, rounds = n, 0
    rows = df.select(*dict.fromkeys(names))
    for name in names:
        kind = df.schema[name].dataType
        if not _Axis.fits(kind):
            return bound | equal if rounds else None
        axis = _Axis(name, kind)
        column = F.col(name)
        nulls = rows.filter(column.isNull()).count() if rounds or df.schema[name].nullable else 0
        if not descending and nulls:
            if nulls >= left:
                rows, equal, rounds = rows.filter(column.isNull()), equal & column.isNull(), rounds + 1
                continue
            bound, left = bound | (equal & column.isNull()), left - nulls
        inside, last = rows.filter(column.isNotNull()), None
        while rounds < _ROUNDS:
            rounds += 1
            found = None
            cells = _cells(inside, axis)
            for count, low, high in reversed(cells) if descending else cells:
                if count >= left:
                    found = (count, low, high)
                    break
                left -= count
            if found is None:
                return None  # rank n lies among the last NULLs, or beyond all rows
            count, low, high = found
            if low != low or high != high:  # NaN: nothing is beyond it
                return None
            last = axis.typed(low if descending else high)
            if low == high or count <= max(SMALL, left) or len(cells) == 1:
                break
            inside = inside.filter(column.between(axis.typed(low), axis.typed(high)))
        if last is None:
            return bound | equal
        beyond = column > last if descending else column < last
        if low != high or count <= SMALL:
            return bound | (equal & (beyond | (column == last)))
        bound = bound | (equal & beyond)
        equal = equal & (column == last)
        rows = rows.filter(column == last)
    return bound | equal
