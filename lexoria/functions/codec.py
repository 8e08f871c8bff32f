"""Lists of word ids as short strings: a version and ids in base 36 with dots between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION = "1"
#: Words that one list holds at most; a list is a link that people pass on.
LONGEST = 500


def to_base36(c: Column) -> Column:
    return F.lower(F.conv(c.cast("string"), 10, 36))


def from_base36(c: Column) -> Column:
    """The number, or null if the segment isn't 1 to 6 base-36 digits of a number above 0."""
    n = F.conv(c, 36, 10).cast("long")
    return F.when(c.rlike("^[0-9a-z]{1,6}$") & (n > 0), n)


def pack_ids(lists: DataFrame, key: str, position: str, word_id: str, most: int = LONGEST) -> DataFrame:
    """(key, packed): each list's ids in order of position, the first `most` of them."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(position, word_id))
    first = lists.where(F.col(word_id).isNotNull()).withColumn("_nth", nth).where(F.col("_nth") <= most)
    items = F.array_sort(F.collect_list(F.struct(F.col("_nth").alias("p"), F.col(word_id).alias("w"))))
    ids = F.transform(items, lambda x: to_base36(x["w"]))
    return first.groupBy(key).agg(F.concat_ws(".", F.lit(VERSION), ids).alias("packed"))


def unpack_ids(lists: DataFrame, key: str, packed: str = "packed", most: int = LONGEST) -> DataFrame:
    """(key, position, word_id) of every valid segment; another version gives nothing."""
    parts = F.split(F.col(packed), r"\.")
    rows = lists.where(F.element_at(parts, 1) == VERSION).select(key, F.posexplode(F.slice(parts, 2, most)).alias("position", "_s"))
    return rows.select(key, "position", from_base36(F.col("_s")).alias("word_id")).where("word_id is not null")
