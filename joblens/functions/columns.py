"""Helpers for building columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often later steps and filters use them.

    The optimizer copies projected expressions into every use, but not past a generator. The
    expressions sit in a projection below it, where what they have in common is computed once.
    """
    names = df.columns
    staged = df.withColumns({f"_once_{name}": column for name, column in columns.items()})
    row = F.struct(*[F.col(f"_once_{name}").alias(name) for name in columns])
    return staged.select(*names, F.inline(F.array(row)))
