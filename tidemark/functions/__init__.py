"""Column expressions that several operators share; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_last(value: str, order: str) -> Column:
    """The greatest value among the rows of greatest order; nulls lose against values of the same order.

    Unlike max_by this doesn't depend on which of the tied rows comes first. Rows without an order sort as the
    latest, as databases that put nulls last have it.
    """
    return F.max(F.struct(F.col(order).isNull(), F.col(order), F.col(value).isNotNull(), F.col(value).alias("v")))["v"]


def greatest_or_null(a: Column, b: Column) -> Column:
    """The greater; null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def ratio(a: Column, b: Column) -> Column:
    """a / b in double; null where b is zero or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


DAY_ZERO = "2020-01-01"


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(DAY_ZERO).cast("date"))


def quality(n: Column, slope: Column, r2: Column, min_train_days: int, r2_gate: float) -> Column:
    """The grade of a fit, by the first rule that holds."""
    return (
        F.when(n < min_train_days, "INSUFFICIENT_HISTORY")
        .when((slope == 0) | r2.isNull(), "FLAT")
        .when(r2 < r2_gate, "LOW_CONFIDENCE")
        .otherwise("OK")
    )


def median_deviation(values: Column, median: Column) -> Column:
    """The median of |x - median| over an array: the mean of the one or two middle ones; null for an empty array."""
    spread = F.array_sort(F.transform(values, lambda x: F.abs(x - median)))
    n = F.size(values)
    middle = F.slice(spread, F.greatest(F.floor((n + 1) / 2).cast("int"), F.lit(1)), 2 - n % 2)
    return F.when(n > 0, F.aggregate(middle, F.lit(0.0), lambda s, x: s + x) / (2 - n % 2))
