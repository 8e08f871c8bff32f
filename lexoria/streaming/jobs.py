"""Streams. Each runs on what is there (`availableNow`) or on and on, with its progress in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexoria.operators.changes import apply_changes
from lexoria.operators.corpus import count_words
from lexoria.plans.runtime import discard, publish, shared_dir


def source(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 1000) -> DataFrame:
    """A table of a directory as a stream of its files."""
    static = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    r = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files_per_batch)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return r.parquet(f"{sf_dir}/{table}.parquet") if fs.getFileStatus(fs_path).isDirectory() else r.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run(stream: DataFrame, name: str, mode: str, each, home: str | None = None) -> str:
    """Run a stream to the end of what is there; `each(batch, id, folder)` handles a batch. A batch that is
    run again after a failure has the same id and writes to the same place."""
    home = home or f"{shared_dir(stream.sparkSession)}/lexoria-stream-{name}-{uuid.uuid4().hex[:8]}"
    q = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/progress")
        .foreachBatch(lambda df, i: each(df, i, f"{home}/out")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return home


def _parts(df: DataFrame, i: int, out: str) -> None:
    df.write.mode("overwrite").parquet(f"{out}/batch={i}")


def parts(spark: SparkSession, home: str, schema) -> DataFrame:
    """All batches' outputs, with `batch`; none if nothing came."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/out")
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(schema).parquet(f"{home}/out")


def count_stream(docs: DataFrame, unit=None, home: str | None = None) -> tuple[DataFrame, str]:
    """(word, occurrences, documents) of a stream of documents. Every batch leaves its counts under its own
    number, so a batch that is run again replaces its counts and none is added twice."""
    home = run(docs, "count", "append", lambda df, i, out: _parts(count_words(df, unit), i, out), home)
    got = parts(docs.sparkSession, home, "word string, occurrences long, documents long")
    return got.groupBy("word").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents")), home


#: Buckets of a stream's state; a batch reads and writes those that its keys fall into.
STATE_BUCKETS = 64


class _State:
    """A keyed state in `home`: `state/batch=I/bucket=K` holds bucket K as it was after batch I, for the
    buckets that batch I touched. A bucket's state before batch I is its version of the highest batch below
    I, so a batch that is run again after a failure begins from what it began from before. A batch's
    versions count once they are whole, which the mark of the writer's success tells."""

    def __init__(self, spark: SparkSession, home: str, buckets: int) -> None:
        self.spark, self.home = spark, home
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        kept = [x for x in self._names(home) if x.startswith("buckets=")]
        self.buckets = int(kept[0][8:]) if kept else buckets
        if not kept:
            self.fs.mkdirs(self.path(f"{home}/buckets={buckets}"))

    def _names(self, at: str) -> list[str]:
        p = self.path(at)
        return [x.getPath().getName() for x in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The batch of each bucket's version that is in force before a batch, or now."""
        out: dict[int, int] = {}
        for name in self._names(f"{self.home}/state"):
            i = int(name.partition("=")[2])
            parts = self._names(f"{self.home}/state/{name}")
            if (before is None or i < before) and "_SUCCESS" in parts:
                for k in (int(x[7:]) for x in parts if x.startswith("bucket=")):
                    out[k] = max(i, out.get(k, -1))
        return out

    def read(self, schema, before: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        have = [f"{self.home}/state/batch={i}/bucket={k}" for k, i in self.versions(before).items() if only is None or k in only]
        return self.spark.read.schema(schema).parquet(*have) if have else None

    def write(self, df: DataFrame, keys: list[str], batch: int) -> None:
        rows = df.withColumn("bucket", self.bucket(keys))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.home}/state/batch={batch}")

    def forget(self, batch: int) -> None:
        """Remove versions that no batch from `batch` on can ask for again."""
        now = self.versions(batch)
        for name in self._names(f"{self.home}/state"):
            i = int(name.partition("=")[2])
            for x in self._names(f"{self.home}/state/{name}"):
                if i < batch and x.startswith("bucket=") and now.get(int(x[7:]), i) > i:
                    self.fs.delete(self.path(f"{self.home}/state/{name}/{x}"), True)

    def bucket(self, keys: list[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")


def change_stream(
    feed: DataFrame, home: str | None = None, known: DataFrame | None = None, quota: int | None = None, buckets: int = STATE_BUCKETS,
    keys: tuple[str, ...] = ("user_id", "word"), payload: tuple[str, ...] = (), **kw,
) -> DataFrame:
    """The state after a stream of changes. A batch reads the buckets of the state that its keys fall into,
    applies its changes to them, and leaves new versions of these under its own number.

    `home`: where progress, state and rejected changes are kept; a stream that is started again with it goes
    on where it stopped. `known` (the last of `keys`): changes of other words are rejected. `quota`: once a
    user, the first of `keys`, has so many live rows before a batch, changes of words without a row are
    rejected too. Rejected changes are in `home`/rejected under their batch.
    """
    spark, keys = feed.sparkSession, list(keys)
    home = home or f"{shared_dir(spark)}/lexoria-stream-changes-{uuid.uuid4().hex[:8]}"
    state = _State(spark, home, buckets)
    kept = [*keys, kw.get("clock", "updated_at"), kw.get("seq", "seq"), kw.get("deleted", "deleted"), *payload]
    schema = feed.select(*kept).schema

    def each(df: DataFrame, i: int, out: str) -> None:
        state.forget(i)
        if known is not None or quota is not None:
            df = _reject(df, i)
        touched = {r["k"] for r in df.select(state.bucket(keys).alias("k")).distinct().collect()}
        new = apply_changes(df, keys, payload=payload, base=state.read(schema, i, touched), **kw)
        state.write(new, keys, i)
        discard(new)

    def _reject(df: DataFrame, i: int) -> DataFrame:
        df = publish(df, "batch")
        refused = F.lit(False)
        if known is not None:
            names = known.select(F.col(known.columns[0]).alias(keys[-1]), F.lit(True).alias("_known")).distinct()
            df = df.join(names, keys[-1], "left")
            refused = F.col("_known").isNull()
        before = state.read(schema, i) if quota is not None else None
        if before is not None:
            full = before.where(F.col(kept[len(keys) + 2]) == 0).groupBy(keys[0]).agg(F.count("*").alias("_n")).where(F.col("_n") >= quota).select(keys[0], F.lit(True).alias("_full"))
            there = before.select(*keys, F.lit(True).alias("_there"))
            df = df.join(full, keys[0], "left").join(there, keys, "left")
            refused = refused | (F.col("_full").isNotNull() & F.col("_there").isNull())
        df = publish(df.withColumn("_refused", refused), "judged")
        gone = [c for c in ("_known", "_full", "_there", "_refused") if c in df.columns]
        df.where("_refused").drop(*gone).write.mode("overwrite").parquet(f"{home}/rejected/batch={i}")
        return df.where("not _refused").drop(*gone)

    run(feed, "changes", "append", each, home)
    got = state.read(schema)
    return spark.createDataFrame([], schema) if got is None else got


STREAK = "user_id long, answers long, correct long, best long, current long"


def _streak(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, ok, best, now = state.get if state.exists else (0, 0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for right in rows["ok"].tolist():
        n, now = n + 1, now + 1 if right else 0
        ok, best = ok + int(right), max(best, now)
    state.update((n, ok, best, now))
    yield pd.DataFrame({"user_id": [key[0]], "answers": [n], "correct": [ok], "best": [best], "current": [now]})


def streak_stream(answers: DataFrame, home: str | None = None) -> DataFrame:
    """Runs of right answers of each user (user_id, ts, event_id, ok), kept as state between batches; with
    a `home` it goes on where it stopped."""
    out = answers.groupBy("user_id").applyInPandasWithState(_streak, STREAK, "n long, ok long, best long, now long", "update", GroupStateTimeout.NoTimeout)
    home = run(out, "streak", "update", _parts, home)
    got = parts(answers.sparkSession, home, STREAK + ", batch int")
    return got.groupBy("user_id").agg(*[F.max_by(c, "batch").alias(c) for c in ("answers", "correct", "best", "current")])


def first_uses(events: DataFrame, token: str, at: str, within: str = "1 hour", home: str | None = None) -> DataFrame:
    """The first use of each token; state is dropped when the watermark has passed it."""
    rows = events.withWatermark(at, within).dropDuplicatesWithinWatermark([token])
    home = run(rows, "once", "append", _parts, home)
    return parts(events.sparkSession, home, rows.schema).drop("batch")


def window_counts(events: DataFrame, who: str, at: str, size: str, late: str = "10 minutes", home: str | None = None) -> DataFrame:
    """(who, start, n) of fixed windows, given out when the watermark has closed them or the stream ends."""
    rows = events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), who).agg(F.count("*").alias("n")).select(who, F.col("w.start").alias("start"), "n")
    home = run(rows, "windows", "update", _parts, home)
    got = parts(events.sparkSession, home, StructType([*rows.schema.fields, StructField("batch", IntegerType())]))
    return got.groupBy(who, "start").agg(F.max_by("n", "batch").alias("n"))
