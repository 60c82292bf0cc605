"""Places in a global order, found from totals of partitions instead of one long window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage


def positions(rows: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """``rows`` with ``pos`` (rows before, from 0) and ``before`` (summed ``weight`` of the rows before).

    Rows are dealt to ranges of ``order`` and written with the number of their range. Totals of the ranges, a row
    for each, are summed up in order; inside a range a window counts on from there. A key that holds many rows is split
    between ranges by the later columns of ``order``, which should tell rows apart.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), name)
    totals = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "range",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("pos0"),
        F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"),
    )
    inside = Window.partitionBy("range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.join(F.broadcast(starts), "range")  # one row for each shuffle partition
    found = found.withColumn("pos", F.col("pos0") + F.row_number().over(inside) - 1)
    found = found.withColumn("before", F.col("w0") + F.sum(weight).over(upto) - F.col(weight))
    return found.drop("range", "pos0", "w0")
