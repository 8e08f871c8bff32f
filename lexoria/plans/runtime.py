"""Session settings, the shared folder, written cut points and size-checked broadcasts.

Every intermediate that is read more than once or would lengthen a loop's lineage goes through
`publish`: a Parquet table in the folder named by ``spark.checkpoint.dir``, written to a staging
name and renamed when complete, so that a lost executor never loses it and a reader never sees half.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def session(name: str = "lexoria", **conf: str) -> SparkSession:
    """A session with the settings that the engine expects; existing settings win on a cluster."""
    b = SparkSession.builder.appName(name)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session, whose executors share this machine's disk, gets a
    folder of its own where the setting is absent, as in tests; on a cluster that is an error."""
    ship(spark)
    at = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED, None)
    if not at:
        at = getattr(spark.sparkContext, "_lexoria_dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError(f"set {SHARED} to a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="lexoria-")
            spark.sparkContext._lexoria_dir = at
    return at.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per context, wherever they run and start."""
    sc = spark.sparkContext
    if not getattr(sc, "_lexoria_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(package):
            made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lexoria-"), "lexoria"), "zip", os.path.dirname(package), os.path.basename(package))
            sc.addPyFile(made)
        sc._lexoria_shipped = True


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def rename(spark: SparkSession, old: str, new: str, fresh: bool = False) -> None:
    """Rename; with `fresh` fail if `new` is there already, instead of moving into it."""
    fs, p = _fs(spark, old)
    if fresh and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise FileExistsError(new)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot publish {new}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def publish(df: DataFrame, name: str) -> DataFrame:
    """Write `df` under the shared folder, rename it into place at once, and read it back.

    The table is deleted when the session's JVM ends. Schema and nullability of columns are kept.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/lexoria-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(f"{root}/_staging")
    rename(spark, f"{root}/_staging", f"{root}/table")
    fs, p = _fs(spark, root)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(f"{root}/table")
    out._lexoria_root = root
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by `publish` that nothing will read again."""
    root = getattr(df, "_lexoria_root", None)
    if root:
        remove(df.sparkSession, root)


def size_in_bytes(df: DataFrame) -> int:
    """Bytes of the rows of `df` as they lie in memory, counted; nested values by their text."""
    wide = {"string": "octet_length({})", "binary": "octet_length({})"}
    fixed = sum(8 for _ in df.dtypes) + 16
    parts = [f"coalesce(sum({wide.get(t, 'octet_length(cast({} as string))').format(f'`{c}`')}), 0)" for c, t in df.dtypes if t in wide or t.startswith(("array", "map", "struct"))]
    return df.agg(F.expr(" + ".join([f"count(1) * {fixed}", *parts])).alias("n")).first()["n"]


def broadcast_within(df: DataFrame, max_bytes: int) -> DataFrame:
    """Hint a broadcast only if the rows of `df` have at most `max_bytes` bytes; beyond it the join shuffles."""
    return F.broadcast(df) if size_in_bytes(df) <= max_bytes else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, *tables: str):
    """One DataFrame per named table of a directory of Parquet tables."""
    ship(spark)
    got = [spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in tables]
    return got[0] if len(got) == 1 else got
