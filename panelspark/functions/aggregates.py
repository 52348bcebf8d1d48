"""Aggregates that have a value, or none, where the built-in ones raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def corr(a: str | Column, b: str | Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of the rows in which both have a value; null where one side does not vary (the built-in one divides by zero there).

    over: the window, for the correlation of its rows.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    of = lambda c: c.over(over) if over is not None else c
    spread = of(F.stddev_pop(F.when(b.isNotNull(), a))) * of(F.stddev_pop(F.when(a.isNotNull(), b)))
    return F.when(spread > 0, of(F.covar_pop(a, b)) / F.when(spread > 0, spread))
