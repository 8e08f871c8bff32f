"""Text statistics of each document, and rules that tell which documents are out of range.

Statistics are native expressions over whole texts. The rules are learned: labelled documents teach,
for each statistic, an ordered list of rules by incremental reduced-error pruning; the learned
thresholds become SQL CASE expressions, which Spark applies to all documents itself and which alone
decide. The stated ranges serve to label the sample and for nothing else, so documents whose value
lies between a learned cut and the stated limit are told wrongly; `agreement` measures how many.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents from which rules are learned, at most about so many, chosen by a hash of the id.
LABELLED = 10_000
#: Words of the list of common words at most; it is part of the plan.
MOST_COMMON = 10_000
# Limits of each statistic, (lowest, highest) in range.
LIMITS = {
    "words": (20, None),
    "word_len": (3.5, 7.5),
    "symbols": (None, 0.125),
    "line_end": (0.5, None),
    "common": (0.25, None),
}
# Characters that end a sentence's line.
LINE_ENDS = ".!?…;:\"”»"
# White space, in the notation of regular expressions.
SPACE = r"\s\x1c-\x1f\x85\xa0  -     　"


def common_list(table: DataFrame, column: str, most: int = MOST_COMMON) -> list[str]:
    """The words of a list that goes into the plan whole; one of more than `most` words is refused."""
    words = [r[0] for r in table.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"the list of common words has over {most} words")
    return words


def statistics(docs: DataFrame, common: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, word_len, symbols, line_end, common): one row per row of `docs`.

    A word is a run of letters of any script in lower case. `words` is their number, `word_len` the
    mean of their letters, `symbols` the share of characters that are neither letter, digit nor white
    space, `line_end` the share of lines that aren't empty and end in a sentence's end, `common` the
    share of words in the list. A ratio over nothing is null; so is every statistic of a null text.
    `common` is a list of bounded size that goes into the plan.
    """
    wanted = list(dict.fromkeys(w.lower() for w in common if w))
    df = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    df = df.select(
        "doc_id",
        F.regexp_extract_all(F.lower("_text"), F.lit(r"(\p{L}+)"), F.lit(1)).alias("word"),
        F.expr(r"filter(transform(split(_text, '\n'), x -> trim(both ' \t' from x)), x -> x <> '')").alias("line"),
        F.length(F.regexp_replace("_text", rf"[\p{{L}}\p{{Nd}}{SPACE}]+", "")).alias("n_symbols"),
        F.length("_text").alias("n_chars"),
    )
    df = df.select(
        "doc_id",
        F.size("word").alias("n_words"),
        F.length(F.array_join("word", "")).alias("n_letters"),
        "n_symbols",
        "n_chars",
        F.size(F.filter("word", lambda w: w.isin(wanted) if wanted else F.lit(False))).alias("n_common"),
        F.size("line").alias("n_lines"),
        F.size(F.filter("line", lambda x: F.right(x, F.lit(1)).isin(list(LINE_ENDS)))).alias("n_ended"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return df.select(
        "doc_id",
        F.when(F.col("n_words") >= 0, F.col("n_words").cast("double")).alias("words"),
        share("n_letters", "n_words").alias("word_len"),
        share("n_symbols", "n_chars").alias("symbols"),
        share("n_ended", "n_lines").alias("line_end"),
        share("n_common", "n_words").alias("common"),
    )


@dataclass(frozen=True)
class Test:
    stat: str
    way: str  # '<' or '>'
    cut: float

    def of(self, data: dict[str, np.ndarray]) -> np.ndarray:
        v = data[self.stat]
        with np.errstate(invalid="ignore"):
            return v < self.cut if self.way == "<" else v > self.cut

    def sql(self) -> str:
        return f"`{self.stat}` {self.way} CAST({self.cut!r} AS DOUBLE)"


Rule = tuple[Test, ...]


def _covers(rule: Rule, data: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.of(data)
    return out


def _between(taken: float, left: float) -> float:
    """A cut that takes the first value and not the second."""
    mid = (float(taken) + float(left)) / 2
    return mid if mid != taken else float(left)


def _grow(data: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """Add the test of the greatest information gain until no negative is covered.

    A cut is put half way between the last value that it takes and the first that it doesn't.
    """
    n, rule, inside = len(y), (), np.ones(len(y), bool)
    while (inside & ~y).any():
        p0, n0 = (inside & y).sum(), (inside & ~y).sum()
        best, gain = None, 0.0
        for stat, v in data.items():
            ok = inside & ~np.isnan(v)
            vals, lab = v[ok], y[ok]
            for way, sign in (("<", 1.0), (">", -1.0)):
                order = np.argsort(sign * vals, kind="stable")
                s, l = (sign * vals)[order], lab[order]
                if not len(s):
                    continue
                first = np.flatnonzero(np.r_[False, s[1:] > s[:-1]])  # cutting here takes all before
                pos, neg = np.cumsum(l)[first - 1], np.cumsum(~l)[first - 1]
                good = (pos > 0) & ~l[first] if len(first) else np.zeros(0, bool)
                if not good.any():
                    continue
                first, pos, neg = first[good], pos[good], neg[good]
                g = pos * (np.log2(pos / (pos + neg)) - np.log2(p0 / (p0 + n0)))
                k = int(np.argmax(g))
                if g[k] > gain + 1e-12:
                    best, gain = Test(stat, way, _between(sign * s[first[k] - 1], sign * s[first[k]])), float(g[k])
        if best is None:
            break
        rule += (best,)
        inside &= best.of(data)
        if not inside.any():
            break
    return rule if (_covers(rule, data, n) & y).any() else ()


def _score(rule: Rule, data: dict[str, np.ndarray], y: np.ndarray) -> float:
    """(p - n) / (p + n) of what the rule takes."""
    c = _covers(rule, data, len(y))
    p, n = (c & y).sum(), (c & ~y).sum()
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, data: dict[str, np.ndarray], y: np.ndarray, whole: dict[str, np.ndarray], y_whole: np.ndarray) -> Rule:
    """The beginning of the rule with the best score on the pruning set; of equal ones, which a small set
    can't tell apart, that with the best score on all documents that are left, then the shortest."""
    scored = [((round(_score(rule[:k], data, y), 12), round(_score(rule[:k], whole, y_whole), 12)), -k) for k in range(1, len(rule) + 1)]
    return rule[: -max(scored)[1]]


def induce(data: dict[str, np.ndarray], y: np.ndarray, seed: int = 0, most_rules: int = 20) -> list[Rule]:
    """An ordered rule list by incremental reduced-error pruning: grow on two thirds, prune on a third,
    keep the rule while it is right more often than not, take out what it covers, and go on."""
    left, rules, r = np.arange(len(y)), [], random.Random(seed)
    while len(rules) < most_rules and y[left].any():
        idx = left.tolist()
        r.shuffle(idx)
        cut = max(1, len(idx) * 2 // 3)
        part = lambda k: ({c: v[k] for c, v in data.items()}, y[k])
        grow_on, prune_on = np.array(idx[:cut], int), np.array(idx[cut:], int)
        if not y[grow_on].any():
            grow_on, prune_on = left, left
        rule = _grow(*part(grow_on))
        if not rule:
            break
        if len(prune_on):
            rule = _prune(rule, *part(prune_on), *part(left))
        c = _covers(rule, *[part(left)[0]], len(left))
        p, n = (c & y[left]).sum(), (c & ~y[left]).sum()
        if p <= n:
            break
        rules.append(rule)
        left = left[~c]
    return rules


def settle(rules: list[Rule], data: dict[str, np.ndarray], y: np.ndarray) -> list[Rule]:
    """Rules were grown on two thirds of what was left: put the cut of each rule of one test half way
    between the last labelled document that it should take and the first beyond that it shouldn't."""
    out = []
    for rule in rules:
        if len(rule) == 1:
            t = rule[0]
            v, sign = data[t.stat], 1.0 if t.way == "<" else -1.0
            hit, no = sign * v[y & t.of(data)], sign * v[~y & ~np.isnan(v)]
            beyond = no[no > hit.max()] if len(hit) else no[:0]
            if len(beyond):
                near = sign * v[y & ~np.isnan(v)]
                near = near[near < beyond.min()]  # those between the old cut and the first that isn't to be taken
                rule = (Test(t.stat, t.way, _between(sign * max(hit.max(), near.max()), sign * beyond.min())),)
        out.append(rule)
    return out


def to_case(rules: list[Rule], yes: str) -> str:
    """The rule list as a SQL CASE expression; the first rule that holds decides."""
    if not rules:
        return "CAST(NULL AS STRING)"
    arms = " ".join(f"WHEN {' AND '.join(t.sql() for t in rule)} THEN '{yes}'" for rule in rules)
    return f"CASE {arms} END"


def label(values: np.ndarray, stat: str) -> np.ndarray:
    """Which values are out of the statistic's stated range; nan is within."""
    low, high = LIMITS[stat]
    out = np.zeros(len(values), bool)
    with np.errstate(invalid="ignore"):
        if low is not None:
            out |= values < low
        if high is not None:
            out |= values > high
    return out


def _sampled(n: int, labelled: int) -> Column:
    """Whether a document is one of the about `labelled` ones of `n`."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // labelled))) == 0


def learn(stats: DataFrame, labelled: int = LABELLED, n_rows: int | None = None) -> dict[str, list[Rule]]:
    """A rule list for each statistic from about `labelled` documents, chosen by hash and labelled by
    the stated ranges. Without a labelled document out of range a statistic has no rules."""
    n = stats.count() if n_rows is None else n_rows
    rows = stats.where(_sampled(n, labelled)).orderBy(F.xxhash64("doc_id", F.lit(1))).limit(2 * labelled).collect()
    data = {s: np.array([np.nan if r[s] is None else r[s] for r in rows], float) for s in LIMITS}
    out = {}
    for stat in LIMITS:
        y = label(data[stat], stat)
        mine = {stat: data[stat], **data}  # of tests that tell as much the statistic's own comes first
        out[stat] = settle(induce(mine, y), mine, y) if y.any() else []
    return out


def flag(stats: DataFrame, rules: dict[str, list[Rule]]) -> DataFrame:
    """(doc_id, stat): documents that the learned CASE expressions take."""
    flags = F.array(*[F.expr(to_case(r, s)) for s, r in rules.items()])
    return stats.select("doc_id", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("stat"))


def agreement(stats: DataFrame, rules: dict[str, list[Rule]], labelled: int = LABELLED, n_rows: int | None = None) -> DataFrame:
    """(stat, cases, flagged, both): over the documents that `learn` didn't see, how many are out of the
    stated range, how many the rules take, and how many are both; recall is both / cases, precision
    both / flagged."""
    n = stats.count() if n_rows is None else n_rows
    unseen, parts = stats.where(~_sampled(n, labelled)), []
    for stat, (low, high) in LIMITS.items():
        c = F.col(stat)
        case = F.coalesce((c < F.lit(float("-inf") if low is None else float(low))) | (c > F.lit(float("inf") if high is None else float(high))), F.lit(False))
        parts.append(F.struct(F.lit(stat).alias("stat"), case.alias("is_case"), F.expr(to_case(rules[stat], stat)).isNotNull().alias("taken")))
    one = unseen.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    return one.groupBy("stat").agg(
        F.count_if("is_case").alias("cases"), F.count_if("taken").alias("flagged"), F.count_if(F.col("is_case") & F.col("taken")).alias("both")
    )


def describe(rules: dict[str, list[Rule]]) -> str:
    """The learned thresholds as text."""
    return "\n".join(f"{s}: " + " | ".join(re.sub(r"CAST\((.*?) AS DOUBLE\)", r"\1", t.sql()) for r in rs for t in r) for s, rs in rules.items())
