"""Exact quantiles of a whole column without gathering its values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.plans.ordered import Ordered


def exact_quantiles(rows: DataFrame, value: Column, shares: dict[str, float], times: Column | None = None) -> DataFrame:
    """One row with a column per share (0.5 is the median), linear between the middle values; NULLs don't count.

    A row counts as ``times`` rows.

    Values are counted first, combined before the shuffle; the wanted order statistics are then those where the
    running counts of the ordered distinct values pass their ranks.
    """
    weight = F.lit(1).cast("long") if times is None else times
    counts = rows.select(value.cast("double").alias("__v"), weight.alias("__w")).where("__v IS NOT NULL").groupBy("__v").agg(
        F.sum("__w").alias("__c"))
    run = Ordered(counts, [], ["__v"]).running(__upto=F.col("__c")).result()
    total = counts.agg(F.sum("__c").alias("__n"))  # one row
    placed = beside(run, total)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("__upto") > rank, F.col("__v")))

    def quantile(share: float) -> Column:
        place = (F.col("__n") - 1) * F.lit(share)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return placed.agg(*[quantile(share).alias(name) for name, share in shares.items()])


def beside(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table of one row."""
    return rows.withColumn("__k", F.lit(1)).join(F.broadcast(one_row.withColumn("__k", F.lit(1))), "__k").drop("__k")
