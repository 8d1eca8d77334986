"""Column functions."""

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, use) -> Column:
    """Bind a value once and use it many times inside one expression."""
    return F.transform(F.array(value), use)[0]


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps read instead of computing again.

    A generator over one struct is a place the optimizer does not fold
    expressions across, so an expensive column used inside a later lambda is
    not evaluated once per element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
