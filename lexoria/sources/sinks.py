"""Writers. Tables are replaced or published whole; a reader never sees a part of one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.operators.keyed import last_per_key
from lexoria.plans.runtime import _fs, remove, rename


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def replace_table(df: DataFrame, path: str) -> None:
    """Drop and rebuild: written under a staging name, then put in force by one rename as the next version
    of the table, which `read_table` reads. The version before stays for readers that are under way; those
    before it go. Nothing is lost or half seen if this fails, and of two writers at once one fails."""
    spark, path = df.sparkSession, path.rstrip("/")
    side = f"{path}/_{uuid.uuid4().hex[:12]}"
    df.write.parquet(side)
    have = _versions(spark, path)
    rename(spark, side, f"{path}/v{have[-1] + 1 if have else 1:08d}", fresh=True)
    for old in have[:-1]:
        remove(spark, f"{path}/v{old:08d}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table that is in force."""
    have = _versions(spark, path)
    if not have:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path.rstrip('/')}/v{have[-1]:08d}")


def create_table(df: DataFrame, path: str) -> None:
    """Refuses if the table is there already."""
    df.write.mode("errorifexists").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Only the partitions that `df` has are wiped and written anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def accumulate(spark: SparkSession, path: str, new: DataFrame, keys: list[str], sums: list[str], latest: list[str]) -> DataFrame:
    """Add counts to a stored table: sums add up, `latest` columns take the latest value."""
    rows = read_table(spark, path).unionByName(new) if _versions(spark, path) else new
    replace_table(merge_counts(rows, keys, sums, latest), path)
    return read_table(spark, path)


def merge_counts(rows: DataFrame, keys: list[str], sums: list[str], latest: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in latest])


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Last wins: stored and new rows, of each key the last by `order`."""
    rows = read_table(spark, path).unionByName(new) if _versions(spark, path) else new
    replace_table(last_per_key(rows, keys, order), path)
    return read_table(spark, path)


def fixed(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """Numbers as text with a fixed number of decimals, for files that people read."""
    return df.withColumns({c: F.format_string(f"%.{n}f", F.col(c).cast("double")) for c, n in places.items()})


def write_csv(df: DataFrame, path: str, places: dict[str, int] | None = None) -> None:
    fixed(df, places or {}).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def append_history(df: DataFrame, path: str) -> None:
    """One JSON object per row, appended."""
    df.write.mode("append").json(path)


def write_lines(df: DataFrame, path: str, line) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def json_store(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, json): the values of each key's rows as an array of objects in order."""
    rows = F.array_sort(F.collect_list(F.struct(*values)))
    return df.groupBy(key).agg(F.to_json(rows).alias("json"))


def keep_newest(listing: DataFrame, time: str, name: str, most: int) -> DataFrame:
    """The `most` newest files of a listing; of equal times the later name."""
    return listing.orderBy(F.col(time).desc_nulls_last(), F.col(name).desc()).limit(most)
