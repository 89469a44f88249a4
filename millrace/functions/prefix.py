"""Running values over a total order without one task that sees all rows.

Rows fall into buckets that ascend with the order. A window within each bucket gives the running value there; one
row per bucket, summed up before, gives what came ahead of it; a join on the bucket brings the two together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(rows: DataFrame, bucket: Column, order: list[str], out: str = "n", start: int = 0) -> DataFrame:
    """`rows` with their numbers in `order`, from `start`; `bucket` has to ascend with `order`."""
    local = rows.withColumn("__bucket", bucket)
    local = local.withColumn("__local", F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)))
    sizes = local.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    ahead = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__ahead"))
    return local.join(offsets, "__bucket").withColumn(out, F.col("__local") + F.col("__ahead") + (start - 1)).drop("__bucket", "__local", "__ahead")


def running_max(rows: DataFrame, value: Column, bucket: Column, order: list[str], out: str = "most") -> DataFrame:
    """`rows` with the largest `value` up to and with each row in `order`; `bucket` has to ascend with `order`."""
    local = rows.withColumn("__bucket", bucket).withColumn("__value", value)
    upto = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = local.withColumn("__local", F.max("__value").over(upto))
    tops = local.groupBy("__bucket").agg(F.max("__value").alias("__top"))
    ahead = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select("__bucket", F.max("__top").over(ahead).alias("__ahead"))
    return local.join(before, "__bucket").withColumn(out, F.greatest("__local", "__ahead")).drop("__bucket", "__value", "__local", "__ahead")
