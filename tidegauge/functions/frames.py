"""Window helpers: every operator orders a symbol's bars by time and so shares one exchange and one sort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window, WindowSpec

def order() -> WindowSpec:
    """A symbol's bars in time order."""
    return Window.partitionBy("symbol").orderBy("ts")


def whole() -> WindowSpec:
    """All bars of a symbol."""
    return Window.partitionBy("symbol")


def past() -> WindowSpec:
    """The current row and all before it."""
    return order().rowsBetween(Window.unboundedPreceding, 0)


def rolling(window: int) -> WindowSpec:
    """The current row and the window - 1 before it."""
    return order().rowsBetween(-(window - 1), 0)


def before(window: int) -> WindowSpec:
    """The window rows before the current one."""
    return order().rowsBetween(-window, -1)


def gated(value: Column, counted: Column, least: int, frame: WindowSpec) -> Column:
    """value where the frame has at least ``least`` non-null ``counted``; null before."""
    return F.when(F.count(counted).over(frame) >= least, value)


def finite(value: Column) -> Column:
    """NaN and infinities become null, the only missing value inside the engine."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero or missing divisor."""
    return F.try_divide(a, b)


def half(window: int, least: int = 2) -> int:
    return max(least, window // 2)


def lookup(key: Column, values: dict, default=None) -> Column:
    """A small fixed table as an expression, without a join."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def sliding_array(value: Column, window: int) -> Column:
    """The frame's values in time order; nulls are left out."""
    return F.collect_list(value).over(rolling(window))


def island(changed: Column) -> Column:
    """Number of the run a row is in, given where runs begin."""
    return F.sum(F.when(changed, 1).otherwise(0)).over(past())
