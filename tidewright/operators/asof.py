"""As-of and range joins, which Spark SQL has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], columns: list[str]) -> DataFrame:
    """Each left row with the last right row of its ``by`` group at or before ``on``; null columns if none.

    Both sides are put in one order per group, and the last right row seen is carried on: one shuffle,
    no join. Right rows with equal times: the largest column values win.
    """
    tag = F.struct(*[F.col(c) for c in columns])
    a = left.select("*", F.lit(None).cast(right.select(tag).schema[0].dataType).alias("__r"), F.lit(1).alias("__side"))
    b = right.select(*[F.col(c) for c in by], F.col(on), tag.alias("__r"), F.lit(0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col(on), "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return out.select(*left.columns, *[F.col(f"__last.{c}").alias(c) for c in columns])


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points joined to the ranges [low, high] that hold them, by equal buckets of ``width`` and then the bounds.

    Ranges go to every bucket they touch, so ``width`` should be near the usual range's length.
    """
    p = points.withColumn("__b", F.floor(F.col(value) / width).cast("long"))
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    return p.join(r, "__b").where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop("__b")
