"""Places in a total order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def running_total(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Sum of `value` over all rows before, in the order of a column with distinct values.

    Rows are dealt by range and summed within each range; a range's base is the sum of the ranges before, one row a range.
    The dealt rows are stored, so that both uses see the same ranges even where a lost task is run again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.withColumn("__v", value).repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("__part").agg(F.sum("__v").alias("__s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("__own", F.coalesce(F.sum("__v").over(own), F.lit(0))).join(F.broadcast(bases), "__part")  # a row a partition
    return out.withColumn(name, F.col("__base") + F.col("__own")).drop("__v", "__part", "__own", "__base")


def medians(df: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """(by, name): the exact median of a column's values in each group (the mean of the two in the middle), without a task or buffer
    that holds a group: values are counted first, and running counts over ranges of (group, value) say which lie in the middle."""
    counts = df.filter(value.isNotNull() & F.col(by).isNotNull()).groupBy(by, value.alias("__x")).agg(F.count("*").alias("__t"))
    ranked = running_total(counts.withColumn("__key", F.struct(by, "__x")), "__key", F.col("__t"), "__below")
    groups = ranked.groupBy(by).agg(F.min("__below").alias("__base"), F.sum("__t").alias("__n"))
    df = ranked.join(groups, by)
    begin = F.col("__below") - F.col("__base")
    holds = lambda place: (begin <= place) & (place < begin + F.col("__t"))
    low, high = F.expr("(__n - 1) div 2"), F.expr("__n div 2")
    middle = df.filter(holds(low) | holds(high))
    return middle.groupBy(by).agg(((F.min("__x") + F.max("__x")) / 2).alias(name))
