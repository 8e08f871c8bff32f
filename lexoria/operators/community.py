"""Votes, marks, lists and games: aggregates over users' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexoria.operators.rank import global_rank, previous, running_sum


def _has(tag: str) -> Column:
    return F.coalesce(F.array_contains("tags", tag), F.lit(False))


def votes(state: DataFrame) -> DataFrame:
    """(word, votes): of each live row +1 for a bookmark or 'lol', else -1 for 'meh'."""
    v = F.when((F.col("bookmarked") == 1) | _has("lol"), 1).when(_has("meh"), -1).otherwise(0)
    return state.where("deleted = 0").groupBy("word").agg(F.sum(v).alias("votes"))


def mark_counts(state: DataFrame) -> DataFrame:
    """(word, n_fav, n_lol, n_up, n_down): n_up counts rows (a user's one row), not marks."""
    fav, lol, meh = F.col("bookmarked") == 1, _has("lol"), _has("meh")
    return state.where("deleted = 0").groupBy("word").agg(
        F.count_if(fav).alias("n_fav"), F.count_if(lol).alias("n_lol"), F.count_if(fav | lol).alias("n_up"), F.count_if(meh).alias("n_down")
    )


def streaks(answers: DataFrame, user: str, mode: str, order: list[str], correct: str) -> DataFrame:
    """(user, mode, answers, correct, best, current): runs of right answers in order, for each mode and
    over 'all' of them; a wrong answer ends a run."""
    rows = answers.select(F.col(user).alias("user"), F.col(mode).alias("mode"), *order, F.col(correct).cast("int").alias("ok"))
    rows = rows.unionByName(rows.withColumn("mode", F.lit("all")))
    run = running_sum(rows, 1 - F.col("ok"), ["user", "mode"], order, "island")
    per = run.groupBy("user", "mode", "island").agg(F.sum("ok").alias("len"), F.count("*").alias("n"))
    return per.groupBy("user", "mode").agg(
        F.sum("n").alias("answers"), F.sum("len").alias("correct"), F.max("len").alias("best"), F.max_by("len", "island").alias("current")
    )


def leaderboard(stats: DataFrame, most: int = 50) -> DataFrame:
    """The best by best run, right answers and user."""
    return stats.orderBy(F.desc("best"), F.desc("correct"), "user").limit(most)


def own_place(stats: DataFrame, user: int) -> DataFrame:
    """A user's place: 1 plus those with a better best run."""
    mine = stats.where(F.col("user") == user).select("user", "best").limit(1)
    best = mine.first()
    return mine.limit(0).withColumn("place", F.lit(0).cast("long")) if best is None else (
        stats.agg((F.count_if(F.col("best") > best["best"]) + 1).alias("place")).select(F.lit(user).cast("long").alias("user"), F.lit(best["best"]).alias("best"), "place")
    )


def merge_states(source: DataFrame, target: DataFrame, key: str, clock: str) -> DataFrame:
    """(key, action, clock): what moving live rows of one user to another does: insert, update where
    strictly newer, else keep."""
    s = source.where("deleted = 0").select(F.col(key), F.col(clock).alias("_s"))
    t = target.select(F.col(key), F.col(clock).alias("_t"))
    both = t.join(s, key, "full")
    action = F.when(F.col("_s").isNull(), "keep").when(F.col("_t").isNull(), "insert").when(F.col("_s") > F.col("_t"), "update").otherwise("keep")
    return both.select(key, action.alias("action"), F.when(action.isin("insert", "update"), F.col("_s")).otherwise(F.col("_t")).alias(clock))


def refresh_list(items: DataFrame, wanted: DataFrame, cap: int = 1000) -> DataFrame:
    """(list, word, position): words no longer wanted go, new ones follow the last position in order."""
    kept = items.join(wanted, ["list", "word"], "left_semi")
    top = items.groupBy("list").agg(F.max("position").alias("_top"))
    new = wanted.join(items, ["list", "word"], "left_anti").select("list", "word").distinct()
    added = global_rank(new, ["word"], "_n", ["list"]).where(F.col("_n") <= cap).join(top, "list", "left")
    added = added.select("list", "word", (F.coalesce("_top", F.lit(-1)) + F.col("_n")).cast("int").alias("position"))
    return kept.select("list", "word", F.col("position").cast("int").alias("position")).unionByName(added).where(F.col("position") < cap)


def fill_list(items: DataFrame, wanted: DataFrame, cap: int = 1000) -> DataFrame:
    """(list, word, position): a list made to hold the first `cap` wanted words. Items that stay keep their
    position; a new one gets the highest position that stays plus its place among the wanted words, so
    gaps are left where words were there already. `items`: list, word, position; `wanted`: list, word, place
    (from 1, without gaps within a list)."""
    w = wanted.where(F.col("place") <= cap).select("list", "word", "place")
    kept = items.join(w, ["list", "word"], "left_semi").select("list", "word", F.col("position").cast("long").alias("position"))
    top = kept.groupBy("list").agg(F.max("position").alias("_top"))
    new = w.join(items, ["list", "word"], "left_anti").join(top, "list", "left")
    return kept.unionByName(new.select("list", "word", (F.coalesce("_top", F.lit(0)) + F.col("place")).cast("long").alias("position")))


def apply_remote(local: DataFrame, remote: DataFrame, key: list[str], clock: str, payload: list[str]) -> DataFrame:
    """A client's rows after the server's changes: a row that is as new as the change or newer stays, a
    tombstone takes an older one away, any other change puts its row in place. `remote` has one row per
    key, with `deleted`; rows of `local` have none."""
    a = local.select(*key, F.struct(clock, *payload).alias("_l"))
    b = remote.select(*key, F.struct(clock, *payload).alias("_r"), F.col("deleted").alias("_d"))
    both = a.join(b, key, "full")
    stays = F.col("_l").isNotNull() & (F.col("_r").isNull() | F.coalesce(F.col(f"_l.{clock}") >= F.col(f"_r.{clock}"), F.lit(False)))
    now = both.select(*key, F.when(stays, F.col("_l")).when(F.coalesce(F.col("_d"), F.lit(0)) == 0, F.col("_r")).alias("_n")).where("_n is not null")
    return now.select(*key, *[F.col(f"_n.{c}").alias(c) for c in (clock, *payload)])


def rate_limited(events: DataFrame, who: str, at: str, seconds: int, most: int, tie: str) -> DataFrame:
    """Events with `allowed`: the first so many of each fixed window of a user."""
    window = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds)
    w = Window.partitionBy(who, "_w").orderBy(at, tie)
    return events.withColumn("_w", window).withColumn("allowed", (F.row_number().over(w) <= most).cast("int")).drop("_w")


def state_changes(events: DataFrame, who: str, at: str, state: Column, tie: str) -> DataFrame:
    """Rows at which a state differs from the one before; the first row counts if it has one."""
    rows = previous(events.withColumn("state", state), F.col("state"), [who], [at, tie], "_before")
    return rows.where(~F.col("state").eqNullSafe(F.col("_before"))).drop("_before")
