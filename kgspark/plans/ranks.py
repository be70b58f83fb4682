"""Row numbers over groups of any size: no group is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.plans.graph import cut


def numbered(df: DataFrame, by: list[str], order: list[Column], number: str = "k", size: str | None = None) -> DataFrame:
    """Adds each row's number in its group, from 0, and the group's size if a name for it is given.

    Rows are dealt to ranges of (group, order), of about equal size whatever the groups; a row's number is its place in
    its range, after the rows that the group has in the ranges before. ``order`` has to tell the rows of a group apart;
    the columns in ``by`` hold no nulls. The ranges are stored, as they are needed twice.
    """
    dealt = cut(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    held = dealt.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    earlier = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    # A row a group and range.
    starts = held.select(*by, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"), F.sum("__n").over(W.partitionBy(*by)).alias("__size"))
    place = F.row_number().over(W.partitionBy(*by, "__range").orderBy(*order)) - 1
    out = dealt.withColumn("__place", place).join(starts, [*by, "__range"]).withColumn(number, F.col("__start") + F.col("__place"))
    if size is not None:
        out = out.withColumn(size, F.col("__size"))
    return out.drop("__range", "__start", "__size", "__place")
