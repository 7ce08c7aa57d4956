"""Running sums over a whole table in an order, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.materialize import materialize


def running(rows: DataFrame, order: list[Column | str], name: str, weight: Column | None = None) -> DataFrame:
    """`rows` with `name`: the sum of `weight` (default 1) over the rows up to and with this one.

    Rows are laid out by ranges of the order; each range sums up by itself and starts with the total of the ranges
    before, of which there are as many as the session's shuffle partitions. Rows equal in `order` come in any order.
    """
    weighed = rows.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    laid = materialize(weighed.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("_part").agg(F.sum("_w").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return laid.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.sum("_w").over(within)).drop("_w", "_part", "_start")
