"""Row numbers and running sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import written


def numbered(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """df with n_ (row number from 1 within its group, in an order that no two rows share), and under each name of sums the sum of its Column over the rows before.

    A prefix sum in two levels: rows are dealt into ranges of (group, order), so a huge group spreads over all tasks; the counts and sums of the ranges, few
    rows, are summed over the ranges before; each range adds its own. The ranges are written, as their bounds are drawn from a sample.
    """
    sums = sums or {}
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *group, *order).withColumn("part_", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*group, "part_").agg(F.count(F.lit(1)).alias("n_"), *(F.sum(c).alias(name) for name, c in sums.items()))
    earlier = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    before = totals.select(*(F.col(g).alias(f"g_{g}") for g in group), F.col("part_").alias("p_"), *(over(F.col(c), earlier).alias(f"before_{c}") for c in ("n_", *sums)))
    same = F.col("part_") == F.col("p_")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"g_{g}"))
    local = Window.partitionBy(*group, "part_").orderBy(*order)
    found = dealt.join(before, same)
    running = [(over(c, local.rowsBetween(Window.unboundedPreceding, -1)) + F.col(f"before_{name}")).alias(name) for name, c in sums.items()]
    return found.select(*df.columns, (F.row_number().over(local) + F.col("before_n_")).alias("n_"), *running)
