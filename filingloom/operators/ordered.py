"""Running sums and ordinals of groups of any size, in two levels: inside blocks, and over the blocks' totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", merge: bool = False) -> DataFrame:
    """``a`` joined with ``b`` on ``keys``, where null equals null; the keys of ``a`` are kept.

    ``merge`` keeps both sides in all partitions, where Spark might send a small ``a`` to the few partitions of ``b``.
    """
    other = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    other = other.hint("merge") if merge else other
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return a.join(other, on, how).drop(*[f"__{k}" for k in keys])


def running_sum(df: DataFrame, keys: list[str], block: Column, order: list, value: Column, name: str, total: str | None = None) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows before in the group's order, and ``total`` over the group.

    ``block`` must not decrease in the order. A task sorts the rows of one block of a group; the blocks' sums are one row each.
    """
    d = df.withColumn("__block", block).withColumn("__value", value)
    per = d.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum"))
    whole = W.partitionBy(*keys)
    base = per.withColumn("__base", F.coalesce(F.sum("__sum").over(whole.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    base = base.withColumn("__total", F.sum("__sum").over(whole)).drop("__sum")
    inside = F.coalesce(F.sum("__value").over(W.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = same_keys(d.withColumn("__inside", inside), base, [*keys, "__block"])
    x = x.withColumn(name, F.col("__base") + F.col("__inside"))
    if total:
        x = x.withColumn(total, F.col("__total"))
    return x.drop("__block", "__value", "__inside", "__base", "__total")
