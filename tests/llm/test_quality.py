import os
import random
import re

import numpy as np
import pytest

from lexoria.llm.quality import LIMITS, LINE_ENDS, Test as Cut, agreement, describe, flag, induce, label, learn, statistics, to_case

COMMON = ["și", "de", "la", "o", "A"]


def brute(text):
    if text is None:
        return dict.fromkeys(LIMITS)
    words = re.findall(r"[^\W\d_]+", text.lower())
    lines = [x for x in (x.strip(" \t") for x in text.split("\n")) if x]
    share = lambda a, b: a / b if b else None
    return {
        "words": float(len(words)),
        "word_len": share(sum(map(len, words)), len(words)),
        "symbols": share(sum(not (c.isalpha() or c.isdecimal() or c.isspace()) for c in text), len(text)),
        "line_end": share(sum(x[-1] in LINE_ENDS for x in lines), len(lines)),
        "common": share(sum(w in {c.lower() for c in COMMON} for w in words), len(words)),
    }


def texts(n, seed):
    r = random.Random(seed)
    pick = lambda k: " ".join(r.choice(["și", "De", "la", "cuvânt", "strălucitoare", "x", "|", "12", "Жук", "s̆i", "-a"]) + r.choice(["", "", ",", ".", "…\n", "\n", " \t\n", ":\n"]) for _ in range(k))
    return [pick(r.choice([0, 1, 5, 19, 20, 21, 60, 200])) for _ in range(n)] + [None, "", " \n\t\n ", "|" * 200_000, "și " * 100_000, " 　", "”", "a\r\nb.\r"]


def test_statistics_against_brute_force(spark):
    ts = texts(150, 1)
    got = statistics(spark.createDataFrame([(i, t, i) for i, t in enumerate(ts)], "doc_id long, text string, words int"), COMMON).collect()
    assert len(got) == len(ts)
    for x in got:
        assert {c: x[c] for c in LIMITS} == pytest.approx(brute(ts[x.doc_id]))


def test_the_learned_rules_alone_decide(spark):
    """With every document labelled the rules are right for all; other rules give other rows."""
    ts = texts(400, 2)
    stats = statistics(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string"), COMMON)
    want = {(i, c) for i, t in enumerate(ts) for c, v in brute(t).items() if v is not None and label(np.array([v]), c)[0]}
    rules = learn(stats)
    assert {(x.doc_id, x.stat) for x in flag(stats, rules).collect()} == want
    assert "words: `words` <" in describe(rules)
    moved = rules | {"words": [(Cut("words", "<", 6.0),)], "common": []}
    got = {(x.doc_id, x.stat) for x in flag(stats, moved).collect()}
    assert got == {(i, c) for i, c in want if c not in ("words", "common")} | {(i, "words") for i, t in enumerate(ts) if t is not None and brute(t)["words"] < 6}


def test_documents_outside_the_sample(spark):
    """Recall and precision where the rules haven't been taught."""
    ts = texts(4000, 3)
    stats = statistics(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string"), COMMON).cache()
    rules = learn(stats, 1000)
    got = agreement(stats, rules, 1000).collect()
    assert {x.stat for x in got} == set(LIMITS)
    for x in got:
        assert x.cases > 20 and x.both >= 0.98 * x.cases and x.both >= 0.98 * x.flagged, x
    stats.unpersist()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_documents_of_the_tables_outside_the_sample(spark):
    from lexoria.llm.queries import _statistics

    stats = _statistics(spark, "/root/testdata/sf0.1").cache()
    got = agreement(stats, learn(stats, 2000), 2000).collect()
    cases, flagged, both = (sum(x[k] for x in got) for k in ("cases", "flagged", "both"))
    assert both >= 0.99 * cases and both >= 0.99 * flagged and sum(x.cases for x in got) > 1000
    stats.unpersist()


def test_rules_reach_held_out_accuracy():
    r = np.random.default_rng(1)
    make = lambda n: {"a": r.normal(size=n), "b": r.normal(size=n), "c": r.normal(size=n)}
    truth = lambda d: (d["a"] > 1) | ((d["b"] < -0.5) & (d["c"] > 0))
    train, test = make(3000), make(3000)
    rules = induce(train, truth(train))
    said = np.zeros(3000, bool)
    for rule in rules:
        c = np.ones(3000, bool)
        for t in rule:
            c &= t.of(test)
        said |= c
    assert (said == truth(test)).mean() > 0.97
    assert to_case([(Cut("a", ">", 1.5),)], "x") == "CASE WHEN `a` > CAST(1.5 AS DOUBLE) THEN 'x' END"
    assert induce(train, np.zeros(3000, bool)) == [] and to_case([], "x") == "CAST(NULL AS STRING)"


def test_empty(spark):
    stats = statistics(spark.createDataFrame([], "doc_id long, text string"), [])
    assert flag(stats, learn(stats)).count() == 0
