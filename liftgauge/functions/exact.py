"""Sums of floating-point numbers that do not depend on the order of the rows.

A number is cut, without error, into whole multiples of three units; those are added as whole numbers, combined on the map
side like any sum, and put together again once, at the end, with one rounding. Cut off is only what lies below
2**-57. Numbers and sums have to be below 2**59; beyond that the job fails (with ANSI arithmetic, Spark's default)
instead of giving a wrong sum. A unit holds 2**26 of the next smaller one, so over 10**11 rows fit into a sum.
"""

from __future__ import annotations

UNITS = (2**4, 2**30, 2**56)
_SHIFT = 26
_MASK = 2**_SHIFT - 1


def parts(x: str) -> list[str]:
    """Whole multiples of 1/UNITS[0], 1/UNITS[1], 1/UNITS[2] that add up to the SQL value `x`."""
    found, rest = [], f"({x})"
    for unit in UNITS:
        number = f"rint({rest} * {unit}D)"
        found.append(f"bigint({number})")
        rest = f"({rest} - {number} / {unit}D)"
    return found


def whole(first: str, second: str, third: str) -> str:
    """The number whose parts are given as SQL values."""
    second = f"({second} + shiftright({third}, {_SHIFT}))"
    first = f"({first} + shiftright({second}, {_SHIFT}))"
    low = f"(({second} & {_MASK}L) * {_MASK + 1}L + ({third} & {_MASK}L))"
    return f"(double({first}) / {UNITS[0]}D + double({low}) / {UNITS[2]}D)"


def exact_sum(x: str, over: str = "") -> str:
    """SQL for the sum of `x`; `over` follows each aggregate, as FILTER or OVER clause."""
    return whole(*(f"sum({p}) {over}" for p in parts(x)))


def exact_avg(x: str, over: str = "") -> str:
    """SQL for the mean of `x`, null over no values."""
    return f"try_divide({exact_sum(x, over)}, count({x}) {over})"
