"""Search of a serving table: filter sheets, scopes, sort orders, pins and pages."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexoria.functions import text as X

PAGE = 250


def parse_multi(raw) -> list[str]:
    """A list or a text with commas, trimmed, empty parts left out."""
    parts = raw if isinstance(raw, (list, tuple)) else str(raw or "").split(",")
    return [p for p in (str(x).strip() for x in parts) if p]


@dataclass
class Sheet:
    """What the filters of a table are. All are optional in a request; names are the parameters."""

    choices: dict[str, tuple[str, list[str]]] = field(default_factory=dict)  # column, all its values
    tags: dict[str, tuple[str, list[str]]] = field(default_factory=dict)  # column of values between '|'
    at_least: dict[str, str] = field(default_factory=dict)
    below: dict[str, str] = field(default_factory=dict)  # null is excluded
    from_: dict[str, str] = field(default_factory=dict)  # null is excluded
    present: dict[str, str] = field(default_factory=dict)  # 1 not null, 0 null
    equal: dict[str, tuple[str, list[str]]] = field(default_factory=dict)  # whitelist
    scaled: dict[str, tuple[str, float]] = field(default_factory=dict)  # 'low-high' of a scale times a factor
    classes: dict[str, tuple[list[str], str]] = field(default_factory=dict)  # flag columns; hide, show or only


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def build_filter(sheet: Sheet, params: dict) -> Column:
    """The conjunction of the filters asked for.

    A multi-select with nothing or everything ticked adds no condition, and values that aren't in
    the sheet are ignored. Classes: 'hide' leaves out rows with any of the bundle's flags; the
    columns of all bundles set to 'only' make one disjunction; null flags are 0.
    """
    conds: list[Column] = []
    for p, (c, every) in sheet.choices.items():
        on = [v for v in parse_multi(params.get(p)) if v in every]
        if on and len(set(on)) < len(every):
            conds.append(F.col(c).cast("string").isin(on))
    for p, (c, every) in sheet.tags.items():
        on = [v for v in parse_multi(params.get(p)) if v in every]
        if on and len(set(on)) < len(every):
            conds.append(F.coalesce(F.arrays_overlap(F.split(F.col(c), r"\|"), F.array(*map(F.lit, on))), F.lit(False)))
    for p, c in sheet.at_least.items():
        if (k := _number(params.get(p))) is not None and k > 0:
            conds.append(F.col(c) >= k)
    for p, c in sheet.below.items():
        if (k := _number(params.get(p))) is not None:
            conds.append(F.coalesce(F.col(c) < k, F.lit(False)))
    for p, c in sheet.from_.items():
        if (k := _number(params.get(p))) is not None:
            conds.append(F.coalesce(F.col(c) >= k, F.lit(False)))
    for p, c in sheet.present.items():
        if str(params.get(p, "")) in ("0", "1"):
            conds.append(F.col(c).isNotNull() if str(params[p]) == "1" else F.col(c).isNull())
    for p, (c, every) in sheet.equal.items():
        if str(params.get(p, "")) in every:
            conds.append(F.col(c).cast("string") == str(params[p]))
    for p, (c, factor) in sheet.scaled.items():
        low, _, high = str(params.get(p, "")).partition("-")
        if (a := _number(low)) is not None:
            conds.append(F.col(c) >= a * factor)
        if (b := _number(high)) is not None:
            conds.append(F.col(c) <= b * factor)
    only: list[Column] = []
    for p, (cols, default) in sheet.classes.items():
        mode = params.get(p, default)
        mode = mode if mode in ("hide", "show", "only") else default
        if mode == "hide":
            conds += [F.coalesce(F.col(c), F.lit(0)) == 0 for c in cols]
        elif mode == "only":
            only += [F.coalesce(F.col(c), F.lit(0)) == 1 for c in cols]
    if only:
        conds.append(reduce(lambda a, b: a | b, only))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def text_search(q: str, word: str = "word", folded: str = "folded") -> Column:
    """The word holds the text in any case, or its folded form holds the folded text."""
    return F.lower(F.col(word)).contains(q.lower()) | F.col(folded).contains(X.fold(F.lit(q)))


def scope(df: DataFrame, sheet: Sheet, params: dict, playlist: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Rows and the mode: a search text beats a playlist, which beats the filters. An empty playlist
    gives no rows."""
    q = str(params.get("q", "")).strip()
    if q:
        return df.where(text_search(q)), "search"
    if playlist is not None:
        return df.join(playlist.select("word").distinct(), "word", "left_semi"), "playlist"
    return df.where(build_filter(sheet, params)), "filter"


def by_marks(df: DataFrame, marks: DataFrame, kind: str, user: int) -> DataFrame:
    """Words that a user bookmarked, noted, marked, tagged ('tag:x') or left unmarked."""
    mine = marks.where((F.col("user_id") == user) & (F.col("deleted") == 0) & F.col("word").isNotNull())
    noted, booked = F.length(F.coalesce("note", F.lit(""))) > 0, F.col("bookmarked") == 1
    tagged = F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0
    kinds = {"bookmarked": booked, "noted": noted, "marked": booked | noted | tagged, "unmarked": booked | noted | tagged}
    cond = F.array_contains("tags", kind[4:]) if kind.startswith("tag:") else kinds.get(kind)
    if cond is None:
        return df
    words = mine.where(F.coalesce(cond, F.lit(False))).select("word").distinct()
    return df.join(words, "word", "left_anti" if kind == "unmarked" else "left_semi")


# Points of a number of votes up to each step, and beyond the last.
VOTE_STEPS, MOST_POINTS = [(0, 0), (1, 3), (2, 4), (4, 6), (8, 8), (16, 10), (32, 12), (64, 15)], 18


def vote_points(votes: Column) -> Column:
    """Points of a number of votes: steps that widen, with the votes' sign."""
    a, steps = F.abs(votes), None
    for most, points in VOTE_STEPS:
        steps = F.when(a <= most, points) if steps is None else steps.when(a <= most, points)
    steps = steps.otherwise(MOST_POINTS)
    return F.when(votes < 0, -steps).otherwise(steps)


def ordered(df: DataFrame, keys: list[Column], demote: str | None = None, pin: str | None = None) -> list[Column]:
    """Sort keys with a pinned word first and words of a demoted beginning last; the word breaks ties."""
    first = [F.when(F.col("word") == pin, 0).otherwise(1)] if pin else []
    if demote:
        first.append(F.when(F.col("word").startswith(demote), 1).otherwise(0))
    return [*first, *keys, F.col("word").asc()]


def page(df: DataFrame, keys: list[Column], number: int = 1, size: int = PAGE) -> DataFrame:
    """One page in an order that must be total; only as many rows as its end are kept while sorting."""
    return df.orderBy(*keys).offset((max(1, number) - 1) * size).limit(size)


def resolve(nodes: DataFrame, q: str, most: int = 8) -> DataFrame:
    """Words whose key equals the folded text, else begins with it, else holds it: the first kind that
    has any; the exact word first, then by falling band and by word."""
    f = X.fold(F.lit(q))
    tier = F.when(F.col("key") == f, 1).when(F.col("key").startswith(f), 2).when(F.col("key").contains(f), 3)
    hits = nodes.withColumn("tier", tier).where("tier is not null").groupBy("word", "band").agg(F.min("tier").alias("tier"))
    best = hits.agg(F.min("tier").alias("t")).first()["t"]
    return hits.where(F.col("tier") == best).orderBy((F.col("word") == q).desc(), F.col("band").desc(), "word").limit(most)


def autocomplete(nodes: DataFrame, q: str, most: int = 8) -> DataFrame:
    return nodes.where(F.col("key").startswith(X.fold(F.lit(q)))).select("word", "band").distinct().orderBy(F.col("band").desc(), "word").limit(most)
