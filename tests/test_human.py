"""Numbers, sizes and times for people, in every range."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lexoria.functions import text as X
from lexoria.plans.queries_text import QUERIES


def count(n):
    return f"{n / 1e9:.1f}B" if n >= 10**9 else f"{n / 1e6:.1f}M" if n >= 10**6 else f"{n:,}"


def size(n):
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n} B" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024


def ago(s):
    return "just now" if s < 60 else f"{s // 60}m ago" if s < 3600 else f"{s // 3600}h ago" if s < 86400 else f"{s // 86400}d ago"


def test_all_ranges(spark):
    r = random.Random(2)
    ns = [0, 999, 1000, 1023, 1024, 1250, 999_999, 1_000_000, 1_250_000, 1_450_000, 1_750_000, 10**9, 2_250_000_000, 1024**4, 1024**5 * 3] + [r.randrange(10 ** r.randint(1, 14)) for _ in range(300)]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", X.grouped_count("n").alias("c"), X.human_size("n").alias("s"), X.human_count("n").alias("h")).collect()
    assert [(g.c, g.s) for g in got] == [(count(g.n), size(g.n)) for g in got]
    assert {g.n: g.h for g in got}[1250] == "1.3k" and {g.n: g.h for g in got}[10**9] == "1.0B"
    now, secs = dt.datetime(2026, 1, 1), [-5, 0, 59, 60, 3599, 3600, 86399, 86400, 9 * 86400 + 5]
    rows = [(s, now - dt.timedelta(seconds=s)) for s in secs]
    got = spark.createDataFrame(rows, "s long, at timestamp").select("s", X.relative_time("at", F.lit("2026-01-01 00:00:00")).alias("x")).collect()
    assert [g.x for g in got] == [ago(g.s) for g in got]


def test_no_count_is_left_out(spark, tmp_path):
    rows = [(i, n, dt.datetime(2025, 12, 31)) for i, n in enumerate((5, 1500, 2_500_000, 3_000_000_000, None))]
    spark.createDataFrame(rows, "id long, occurrence_count long, last_updated timestamp").write.parquet(f"{tmp_path}/corpus_word_frequency.parquet")
    got = {r.id: r.short for r in QUERIES["scl_37_all"](spark, str(tmp_path)).collect()}
    assert got == {0: "5", 1: "1.5k", 2: "2.5M", 3: "3.0B", 4: None}
