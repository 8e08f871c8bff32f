"""Samples that come out the same each time, by hash of the key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexoria.operators.rank import global_rank


def order_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, 1 to 100."""
    return df.orderBy(order_key(key, seed), key).limit(max(1, min(100, n)))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0, taken: DataFrame | None = None) -> DataFrame:
    """n rows of each stratum; strata of `taken` keep what they have.

    The window keeps n rows per stratum before the shuffle (Spark's window group limit), so a large
    stratum never comes together whole.
    """
    fresh = df if taken is None else df.join(taken.select(stratum).distinct(), stratum, "left_anti")
    w = Window.partitionBy(stratum).orderBy(order_key(key, seed), key)
    new = fresh.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).select(*df.columns)
    return new if taken is None else taken.select(*new.columns).unionByName(new)


def of_the_day(df: DataFrame, key: str, day: int) -> DataFrame:
    """The row whose place in the order of keys is the day's number modulo the count."""
    n = df.count()
    return global_rank(df, [key], "_nth").where(F.col("_nth") == day % n + 1).drop("_nth") if n else df.limit(0)
