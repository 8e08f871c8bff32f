"""Streams that stop and go on, and what a stream of changes refuses."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from lexoria.operators.changes import apply_changes
from lexoria.streaming import jobs

SCHEMA = "user_id long, word string, updated_at long, seq long, deleted int, note string"


def changes(seed, n=400):
    r = random.Random(seed)
    return [(r.randrange(4), f"w{r.randrange(60)}", r.randrange(50), seed * 1000 + i, int(r.random() < 0.2), r.choice([None, "x", "y"])) for i in range(n)]


class Feed:
    """A folder of one file a batch."""

    def __init__(self, spark, at):
        self.spark, self.at, self.rows = spark, str(at), []

    def add(self, rows):
        self.rows += rows
        tmp = f"{self.at}-tmp"
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(tmp)
        import glob
        import os

        os.makedirs(self.at, exist_ok=True)
        shutil.move(glob.glob(f"{tmp}/*.parquet")[0], f"{self.at}/{len(self.rows):06d}.parquet")

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.at)

    def state(self):
        return sorted(map(tuple, apply_changes(self.spark.createDataFrame(self.rows, SCHEMA), payload=("note",)).collect()), key=str)


def test_a_stream_of_changes_goes_on_after_a_restart(spark, tmp_path):
    feed, home = Feed(spark, tmp_path / "feed"), f"file://{tmp_path}/home"
    go = lambda: sorted(map(tuple, jobs.change_stream(feed.stream(), home, buckets=5, payload=("note",)).collect()), key=str)
    feed.add(changes(1))
    feed.add(changes(2))
    assert go() == feed.state()
    feed.add(changes(3))
    feed.add(changes(4))
    assert go() == feed.state() and go() == feed.state()
    touched = jobs._State(spark, home, 99)
    assert touched.buckets == 5 and len(touched.versions()) == 5
    # superseded versions go; only one batch's are kept besides those in force
    import os

    held = [x for d in os.listdir(tmp_path / "home/state") for x in os.listdir(tmp_path / "home/state" / d) if x.startswith("bucket=")]
    assert len(held) <= 10


def test_a_batch_that_failed_half_way_is_run_again(spark, tmp_path, monkeypatch):
    feed, home = Feed(spark, tmp_path / "feed"), f"file://{tmp_path}/home"
    for k in (1, 2, 3):
        feed.add(changes(k))
    real, seen = jobs._State.write, []

    def fails(self, df, keys, batch):
        real(self, df, keys, batch)
        seen.append(batch)
        if seen == [0, 1]:
            raise RuntimeError("stopped after its state was written, before the batch was over")

    monkeypatch.setattr(jobs._State, "write", fails)
    with pytest.raises(Exception):
        jobs.change_stream(feed.stream(), home, payload=("note",))
    got = jobs.change_stream(feed.stream(), home, payload=("note",))
    assert seen == [0, 1, 1, 2] and sorted(map(tuple, got.collect()), key=str) == feed.state()


def test_only_touched_buckets_are_written(spark, tmp_path):
    feed, home = Feed(spark, tmp_path / "feed"), f"file://{tmp_path}/home"
    feed.add(changes(1))
    feed.add([(1, "w1", 999, 5000, 0, "new")])
    got = jobs.change_stream(feed.stream(), home, buckets=16, payload=("note",))
    assert sorted(map(tuple, got.collect()), key=str) == feed.state()
    versions = list(jobs._State(spark, home, 16).versions().values())
    assert versions.count(1) == 1 and versions.count(0) >= 10


def test_unknown_words_and_users_over_their_quota_are_refused(spark, tmp_path):
    feed, home = Feed(spark, tmp_path / "feed"), f"file://{tmp_path}/home"
    feed.add([(1, "a", 1, 1, 0, None), (1, "b", 1, 2, 0, None), (1, "zzz", 1, 3, 0, None), (2, "a", 1, 1, 0, None), (3, "a", 1, 1, 0, None), (3, "b", 1, 2, 1, None)])
    feed.add([(1, "c", 2, 4, 0, None), (1, "a", 2, 5, 0, "edited"), (2, "c", 2, 2, 0, None), (3, "c", 2, 3, 0, None), (None, "a", 1, 1, 0, None)])
    feed.add([(2, "b", 3, 3, 0, None), (3, "b", 3, 4, 0, None), (1, "c", 3, 6, 0, None)])
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    got = jobs.change_stream(feed.stream(), home, known=known, quota=2, payload=("note",))
    # user 1 is full after the first batch, user 2 and 3 after the second; a word that has a row may change
    assert {(r.user_id, r.word, r.note) for r in got.where("deleted = 0").collect()} == {(1, "a", "edited"), (1, "b", None), (2, "a", None), (2, "c", None), (3, "a", None), (3, "b", None), (3, "c", None)}
    refused = spark.read.parquet(f"{home}/rejected")
    assert {(r.batch, r.user_id, r.word) for r in refused.collect()} == {(0, 1, "zzz"), (1, 1, "c"), (2, 2, "b"), (2, 1, "c")}


def test_no_changes_give_no_state(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.coalesce(1).write.parquet(f"{tmp_path}/feed")
    assert jobs.change_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/feed"), payload=("note",)).count() == 0


def test_other_streams_go_on_too(spark, tmp_path):
    at, rows = f"{tmp_path}/answers", [(i % 3, i, i, int(i % 5 != 0)) for i in range(60)]
    schema = "user_id long, ts long, event_id long, ok int"
    whole = spark.createDataFrame(rows, schema)
    stream = lambda: spark.readStream.schema(schema).parquet(at)
    home = f"file://{tmp_path}/home"
    whole.where("ts < 30").coalesce(1).write.parquet(at)
    assert jobs.streak_stream(stream(), home).agg(F.sum("answers")).first()[0] == 30
    whole.where("ts >= 30").coalesce(1).write.mode("append").parquet(at)
    got = {r.user_id: (r.answers, r.correct, r.best, r.current) for r in jobs.streak_stream(stream(), home).collect()}
    want = {}
    for u, _, _, ok in rows:
        n, c, b, now = want.get(u, (0, 0, 0, 0))
        now = now + 1 if ok else 0
        want[u] = (n + 1, c + ok, max(b, now), now)
    assert got == want
