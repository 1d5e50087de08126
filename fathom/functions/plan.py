"""Help for the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are computed once per row: unlike a projection, a generator of one row keeps filters above it
    from being pushed down with copies of its expressions. For expensive expressions that filters and results share."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()])))
    return df.select("*", made.alias("__made")).select(*df.columns, "__made.*")
