"""Running totals over a global order, without a window that holds the whole table.

A window without partitions runs in one task.  Here the order is cut into ranges at
approximate quantiles; each range is a window of its own, and what comes before it is added
from the ranges' totals, a table of as many rows as there are ranges.
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_ranges(df: DataFrame, key: str, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the number of its range of ``key`` (a double without nulls) as ``name``."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(key, [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    splits = [-float("inf"), *(c for c in cuts or [0.0] if abs(c) != float("inf")), float("inf")]
    return Bucketizer(splits=splits, inputCol=key, outputCol=name, handleInvalid="keep").transform(df)


def running_totals(df: DataFrame, key: str, values: dict[str, str], *, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``df`` with, for each (new name, column), the total of the column over all rows whose
    key comes before or with the row's own; equal keys get the same total."""
    part = f"part_{uuid.uuid4().hex[:8]}"
    cut = with_ranges(df, key, part, ranges)
    order = Window.orderBy(F.col(part).desc() if descending else F.col(part)).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(part).agg(*[F.sum(c).alias(f"{part}_{n}") for n, c in values.items()])
    before = totals.select(part, *[F.coalesce(F.sum(f"{part}_{n}").over(order), F.lit(0)).alias(f"{part}_{n}") for n in values])
    inside = Window.partitionBy(part).orderBy(F.col(key).desc() if descending else F.col(key)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cut.join(F.broadcast(before), part)  # one row for each range
        .withColumns({n: F.sum(c).over(inside) + F.col(f"{part}_{n}") for n, c in values.items()})
        .drop(part, *[f"{part}_{n}" for n in values])
    )


def average_ranks(df: DataFrame, key: str, *, ranges: int | None = None) -> DataFrame:
    """(key, n, rank): each distinct key, how often it occurs, and the average rank, from 1,
    of its rows in ascending order."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    upto = running_totals(counts, key, {"upto": "n"}, ranges=ranges)
    return upto.select(key, "n", (F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias("rank"))


def _numeric_order(df: DataFrame, key: str):
    """A double that never decreases along the order of ``key``: its value, or the first
    six bytes of its text as a number."""
    if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return F.col(key).cast("double")
    head = F.rpad(F.substring(F.hex(F.encode(F.col(key).cast("string"), "UTF-8")), 1, 12), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def dense_ranks(df: DataFrame, key: str, *, ranges: int | None = None) -> DataFrame:
    """(key, rank): the distinct keys that aren't NULL, of any type that has an order, with
    their number in it, from 1.  Text is ordered by its bytes."""
    near, part, before = (f"{n}_{uuid.uuid4().hex[:8]}" for n in ("near", "part", "before"))
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    cut = with_ranges(keys.withColumn(near, _numeric_order(keys, key)), near, part, ranges)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(part).orderBy(key)
    return cut.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(counts), part).select(key, (F.col("rank") + F.col(before)).alias("rank"))
