"""Row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_filter(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Keep rows with ``lo <= v <= hi`` for every bounded variable.

    A row missing any bounded variable is dropped, even at full range (a NULL
    comparison is false).  A plain conjunction, so Catalyst pushes the bounds
    into the Parquet scan when the columns come straight from a file.
    """
    cond = F.lit(True)
    for v, (lo, hi) in bounds.items():
        cond = cond & F.col(v).between(F.lit(float(lo)), F.lit(float(hi)))
    return df.filter(F.coalesce(cond, F.lit(False)))


def supplier_subset(df: DataFrame, suppliers: Sequence[str]) -> DataFrame:
    """Keep the listed suppliers.

    The list is caller input (a handful of names for a side-by-side view), so a
    broadcast left-semi join of that list is bounded by what the caller passes.
    """
    spark = df.sparkSession
    names = spark.createDataFrame([(s,) for s in dict.fromkeys(suppliers)], "supplier string")
    return df.join(F.broadcast(names), "supplier", "left_semi")
