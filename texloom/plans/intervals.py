"""Interval joins that form no pair of rows which lie far apart, on keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(low: Column, high: Column, width: float) -> Column:
    return F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], width: float) -> DataFrame:
    """left joined to right where the keys are equal and the closed intervals share a point, each pair once.

    An interval stands in each bin of its axis that it touches, and rows meet in a bin only; the bin of the
    greater of the two beginnings tells the one that gives the pair.  An interval without an end, or whose end lies before its
    beginning, is in no bin.  Column names of the two sides differ but for the keys.
    """

    def dealt(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        low, high = map(F.col, ends)
        return df.where(low <= high).withColumn("_bin", F.explode(_bins(low, high, width)))

    (a, b), (c, d) = ([F.col(x) for x in ends] for ends in (left_ends, right_ends))
    # Spark's estimate of a side knows nothing of the bins, and a side taken for small would be whole on the driver
    near = dealt(left, left_ends).hint("merge").join(dealt(right, right_ends).hint("merge"), [*keys, "_bin"])
    return near.where((a <= d) & (c <= b) & (F.col("_bin") == F.floor(F.greatest(a, c) / width).cast("long"))).drop("_bin")
