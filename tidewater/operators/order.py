"""Values by their place in the order of a column, without sorting the column in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that the driver orders at most, and ranges that more of them are counted in at a time.
FEW, RANGES = 1 << 16, 1 << 10


def value_at(df: DataFrame, column: str, place: int, few: int = FEW):
    """The value at `place` (from 0) of the sorted non-null values of a numeric column; None if there are no more than that.

    Ranges between the least and the greatest value are counted and the one that holds the place is counted again, until it
    has few values or one.
    """
    rows = df.select(F.col(column).alias("v")).where("v is not null")
    n, low, high = rows.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not 0 <= place < n:
        return None
    while n > few and low != high:
        width = (float(high) - float(low)) / RANGES
        if not width:
            break
        at = F.least(F.floor((F.col("v").cast("double") - float(low)) / width), F.lit(RANGES - 1))
        for part in sorted(rows.groupBy(at.alias("at")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: r["at"]):
            if place < part["n"]:
                break
            place -= part["n"]
        if (part["n"], part["low"], part["high"]) == (n, low, high):
            break
        n, low, high = part["n"], part["low"], part["high"]
        rows = rows.where(F.col("v").between(low, high))
    # Few rows, or values so close that few differ.
    for v, k in sorted(tuple(r) for r in rows.groupBy("v").agg(F.count("v")).collect()):
        if place < k:
            return v
        place -= k
    return None
