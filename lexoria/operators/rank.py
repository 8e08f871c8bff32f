"""Ranks over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexoria.plans.runtime import publish, shuffle_width


def global_rank(df: DataFrame, order: list, name: str = "rank", within: list[str] | None = None) -> DataFrame:
    """`df` with `name`: its place, from 1, in the order; with `within`, the place among the rows alike in
    those columns.

    The rows are range-partitioned by (within, order), sorted in each partition and numbered there;
    counts of the partitions before, a few numbers per partition and group, give the offset. So no
    partition holds more than its range, however large a group is. Ties should be broken by `order`.
    """
    within = within or []
    keys = [*within, *order]
    w = shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(w, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    ranged = publish(ranged, "ranged")  # partition numbers must stay what they were
    per = ranged.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if not within:
        per = per.withColumn("_one", F.lit(1))
        before = Window.partitionBy("_one").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    per = per.select(F.col("_part").alias("_p"), "_first", "_before", *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)])
    cond = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    joined = ranged.join(per, cond, "left")
    return joined.select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias(name))


def percentile_ranks(df: DataFrame, value: str, tie: str, name: str = "pct") -> DataFrame:
    """Rows with value > 0 and their place by (value, tie) divided by their number: in (0, 1], no two alike."""
    rows = df.where(F.col(value) > 0)
    ranked = global_rank(rows, [value, tie], "_rank")
    return ranked.withColumn(name, F.col("_rank") / F.lit(max(1, ranked.count()))).drop("_rank")


def new_numbers(known: DataFrame, names: DataFrame, name: str = "name", number: str = "number") -> DataFrame:
    """Known (name, number) and, for unseen names in their order, the next numbers."""
    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(known, name, "left_anti")
    top = known.agg(F.coalesce(F.max(number), F.lit(0)).alias("top")).first()["top"]
    added = global_rank(fresh, [name], "_k").select(name, (F.lit(top) + F.col("_k")).cast("long").alias(number))
    return known.select(name, F.col(number).cast("long").alias(number)).unionByName(added)


def running_sum(df: DataFrame, value, within: list[str], order: list, name: str) -> DataFrame:
    """`df` with `name`: the sum of `value` from the group's first row to this one, in the order.

    Like `global_rank`, without bringing a group together: sums within range partitions, and the sums
    of the group's partitions before.
    """
    keys = [*within, *order]
    w = shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(w, *keys).sortWithinPartitions(*keys).withColumn("_v", value)
    ranged = publish(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "ranged")
    here = Window.partitionBy("_part", *within).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*[f"_w{i}" for i in range(len(within))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy(F.col("_part").alias("_p"), *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)]).agg(F.sum("_v").alias("_s"))
    per = per.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    cond = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    local = ranged.withColumn("_here", F.sum("_v").over(here))
    return local.join(per, cond, "left").select(*df.columns, (F.col("_here") + F.col("_before")).alias(name))


def previous(df: DataFrame, value, within: list[str], order: list, name: str) -> DataFrame:
    """`df` with `name`: `value` in the group's row before this one in the order, null for the first.

    The row before the first of a range partition is the last of the nearest earlier partition that
    has rows of the group, so no group comes together in one task.
    """
    keys = [*within, *order]
    w = shuffle_width(df.sparkSession)
    ranged = df.withColumn("_v", value).repartitionByRange(w, *keys).sortWithinPartitions(*keys)
    ranged = publish(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "ranged")
    here = Window.partitionBy("_part", *within).orderBy("_id")
    per = ranged.groupBy(F.col("_part").alias("_p"), *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)]).agg(
        F.max_by(F.struct("_v"), "_id").alias("_last"), F.min("_id").alias("_first")
    )
    per = per.withColumn("_before", F.lag("_last").over(Window.partitionBy(*[f"_w{i}" for i in range(len(within))]).orderBy("_p"))).drop("_last")
    cond = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    got = ranged.withColumn("_lag", F.lag("_v").over(here)).join(per, cond, "left")
    return got.select(*df.columns, F.when(F.col("_id") == F.col("_first"), F.col("_before")["_v"]).otherwise(F.col("_lag")).alias(name))
