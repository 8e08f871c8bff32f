"""One row per key: first, last, best. All combine before the shuffle, so hot keys do no harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(order: list) -> Column:
    return F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of each key the row that comes first by `order`; ties by the rest of the row. Nulls come first."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(_order(order).alias("_lex_order"), *rest)).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def last_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of each key the row that comes last by `order`; ties by the rest of the row. Nulls come first."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(_order(order).alias("_lex_order"), *rest)).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def preferred_per_key(df: DataFrame, keys: list[str], preferred: Column, order: list) -> DataFrame:
    """Rows that are preferred beat others; then the first by `order`."""
    return first_per_key(df, keys, [F.when(preferred, 0).otherwise(1), *order])


def distinct_in_order(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Distinct keys with their first position."""
    return df.groupBy(*keys).agg(F.min(position).alias(position))


def lookup_two_tier(df: DataFrame, key: str, table: DataFrame, table_key: str, fold, values: list[str]) -> DataFrame:
    """`values` by the exact key, else by the folded key if just one key of the table folds to it."""
    exact = table.select(F.col(table_key).alias("_k"), *[F.col(v).alias(f"_e_{v}") for v in values])
    folded = (
        table.withColumn("_f", fold(F.col(table_key))).groupBy("_f")
        .agg(F.count("*").alias("_n"), *[F.min(v).alias(f"_f_{v}") for v in values]).where("_n = 1").drop("_n")
    )
    got = df.withColumn("_g", fold(F.col(key))).join(exact, F.col(key) == F.col("_k"), "left").join(folded, F.col("_g") == F.col("_f"), "left")
    pick = [F.when(F.col("_k").isNotNull(), F.col(f"_e_{v}")).otherwise(F.col(f"_f_{v}")).alias(v) for v in values]
    return got.select(*df.columns, *pick)
