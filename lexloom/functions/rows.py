"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column | str, keep: list, *item: str, at: str = "_at") -> DataFrame:
    """One row per element of a computed array (or entry of a map), with its position if ``at`` is given.

    The inner form of explode makes the optimizer put a filter on the array's
    size below the projection, and all the work that makes the array is done
    again for it, once per mention. The outer form has no such filter.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, *item)).where(F.col(at).isNotNull())
    return rows.drop("_at") if at == "_at" else rows


def where_once(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet a condition on columns that are costly to make.

    A plain filter is put below the projections that make such columns, where their work is done again for every mention in it. What
    an outer explode makes of the condition stays where it is.
    """
    return unnest(df, F.when(condition, F.array(F.lit(True))), df.columns, "_met").drop("_met")
