"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters and lambdas read as plain values.

    The optimizer moves filters below projections by copying the expressions they use. With a
    copy inside an array lambda, the whole array would be computed again for each element. A
    generator over one struct is not copied; it yields exactly one row.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.explode_outer(F.array(row)).alias("_pinned")).select(*kept, "_pinned.*")


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def total_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)
