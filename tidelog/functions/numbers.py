"""Exact integer arithmetic on sim times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(x: Column | str, by: int) -> Column:
    """x / by rounded down, in long arithmetic (a double has too few bits for nanoseconds)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by)) if by != 1 else x
