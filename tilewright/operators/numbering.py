"""Consecutive numbers over a whole table, without ordering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.state import cut


def numbered(df: DataFrame, by: list[str], name: str = "id") -> DataFrame:
    """``df`` with ``name``, from 0 on in the order of ``by``.

    Rows are dealt out by ranges and ordered within each; only the ranges'
    sizes, a row for each partition, are added up in a single task.
    """
    parts = cut(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").count()
    before = sizes.select(F.col("__part").alias("__p"), (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    own = parts.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(*by)) - 1)
    own = own.join(F.broadcast(before), F.col("__part") == F.col("__p"))
    return own.withColumn(name, (F.col("__own") + F.col("__before")).cast("bigint")).drop("__own", "__part", "__p", "__before")
