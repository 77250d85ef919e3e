"""Running totals without a window over a whole hot partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(df: DataFrame, part: str, at: str, ties: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over earlier rows of the partition, in the order (at, ties).

    Prefix sums are taken over the days of a partition and then inside each day, so a
    partition with most of the rows is spread over its days.
    """
    rows = df.withColumn("__day", F.date_trunc("day", at))
    opening = (
        rows.groupBy(part, "__day")
        .agg(F.sum(value).alias("__net"))
        .withColumn("__open", F.coalesce(F.sum("__net").over(W.partitionBy(part).orderBy(F.asc_nulls_first("__day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col(part).alias("__p"), F.col("__day").alias("__d"), "__open")
    )
    inner = W.partitionBy(part, "__day").orderBy(F.asc_nulls_first(at), *ties).rowsBetween(W.unboundedPreceding, -1)
    within = rows.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = within.join(opening, within[part].eqNullSafe(opening["__p"]) & within["__day"].eqNullSafe(opening["__d"]))
    return joined.withColumn(name, F.col("__in") + F.col("__open")).drop("__day", "__in", "__p", "__d", "__open")


def until_target(df: DataFrame, part: str, at: str, ties: list[str], value: str, target: int) -> DataFrame:
    """Rows while the total of the rows before them is under the target."""
    return running_total(df, part, at, ties, value, "before").where(F.col("before") < target)


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """First row of each key in the given order; the rank filter is pushed below the shuffle."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
