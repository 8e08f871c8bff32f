import random
import unicodedata

from lexoria.functions import text as X

import math
import random

import pytest
from pyspark.sql import functions as F

from lexoria.operators import corpus as C
from lexoria.operators.keyed import first_per_key, last_per_key, lookup_two_tier, preferred_per_key
from lexoria.operators.rank import global_rank, new_numbers, percentile_ranks, previous, running_sum


def rolled(spark, freqs, forms, loose=False):
    counts = spark.createDataFrame([(w, o, d) for w, (o, d) in freqs.items()], "word string, occurrences long, documents long")
    claims = C.form_map(spark.createDataFrame([(f, x) for f, ls in forms.items() for x in ls], "form string, lemma string"))
    if loose:
        return {r.lemma: r.occurrences for r in C.roll_up_loose(counts, claims).collect()}
    return {r.lemma: (r.occurrences, r.documents) for r in C.roll_up(counts, claims).collect()}


def test_roll_up(spark):
    assert rolled(spark, {"înmărmuri": (317, 100), "înmărmurit": (5846, 900)}, {"înmărmuri": ["înmărmuri"], "înmărmurit": ["înmărmuri"]})["înmărmuri"][0] == 6163
    veste = {"veste": (576766, 1000), "veșcă": (264, 20), "vești": (300000, 800)}
    forms = {"veste": ["veste"], "veșcă": ["veșcă"], "vești": ["veste", "veșcă"]}
    got = rolled(spark, veste, forms)
    assert got["veșcă"][0] < 1000 and got["veste"][0] > 800_000
    assert sum(o for o, _ in got.values()) == pytest.approx(sum(o for o, _ in veste.values()), abs=1)
    assert rolled(spark, veste, forms, True) == {"veste": 876766, "veșcă": 300264}
    assert rolled(spark, {"a": (10, 7), "b": (10, 3)}, {"a": ["x"], "b": ["x"]})["x"] == (20, 7)
    vaz = rolled(spark, {"văz": (888, 392), "vedea": (7000, 3000)}, {"văz": ["văz", "vedea"]})
    assert 0 < vaz["văz"][1] < vaz["vedea"][1]
    even = rolled(spark, {"shared": (1000, 500), "big": (9000, 0), "small": (0, 0)}, {"shared": ["small", "big"]})
    assert even["small"][0] / 1000 == pytest.approx(even["small"][1] / 500, abs=0.02)
    assert rolled(spark, {"x": (5, 2)}, {}) == {"x": (5, 2)}


@pytest.mark.parametrize(
    "row, want",
    [((41, 21, 1747, 0.07), "declining"), ((41, 21, 5000, 0.07), "alive"), ((10, 5, 0, 0.5), "extinct"), ((10, 5, 1, 0.5), "historical_only"),
     ((15, 1, 3, 0.5), "absent"), ((15, 2, 3, 0.5), "historical_only"), ((50, 10, 499, 0.2), "historical_only"), ((50, 10, 500, 0.2), "declining"),
     ((50, 10, 2000, 0.2), "alive"), ((50, 10, 2000, -0.2), "emerging")],
)
def test_verdicts(spark, row, want):
    assert spark.range(1).select(C.verdict(*map(F.lit, row)).alias("v")).first().v == want


def test_bands_and_scales(spark):
    got = [tuple(r) for r in spark.createDataFrame([(0,), (1,), (9,), (10,), (999,), (1000,), (10**9,), (None,)], "n long").select(C.band(F.col("n")).alias("b"), C.banded(F.col("n"), [(10, 1), (1000, 2)], 3).alias("p")).collect()]
    assert [b for b, _ in got] == [0, 1, 1, 2, 3, 4, 7, 0] and [p for _, p in got[:7]] == [1, 1, 1, 2, 2, 3, 3]
    assert C.scale_bar(500, 16_969_999_321) == 500 and C.scale_bar(500, 0) == 500
    r = spark.range(1).select(C.log_ratio(F.lit(10), F.lit(0)).alias("l"), C.per_million(F.lit(5), F.lit(0)).alias("p"), C.zipf(F.lit(1), F.lit(10**9)).alias("z"), C.rarity(F.lit(0.3)).alias("r")).first()
    assert r.l == pytest.approx(math.log2(10.1 / 0.1)) and r.p == 0 and r.z == 0 and r.r == "rare"


def test_counts_by_author(spark):
    docs = [(0, "A", "cuvânt cuvânt"), (1, "A", "CUVÂNT jupâneşică"), (2, "A", "cuvânt necuvânt zzz a ab"), (3, None, "altul"), (4, None, "altul"), (5, "B", None)]
    df = spark.createDataFrame(docs, "id long, author string, text string")
    vocab = spark.createDataFrame([("cuvânt",), ("jupâneșică",), ("altul",)], "word string")
    got = {r.word: (r.occurrences, r.documents) for r in C.count_words(df, F.coalesce("author", F.concat(F.lit("__"), "id")), vocabulary=vocab).collect()}
    assert got == {"cuvânt": (4, 1), "jupâneșică": (1, 1), "altul": (2, 2)}
    rows = {r.word: (r.occurrences, r.documents) for r in C.count_words(df).collect()}
    assert rows == {"cuvânt": (4, 3), "jupâneșică": (1, 1), "altul": (2, 2), "necuvânt": (1, 1), "zzz": (1, 1)}
    assert C.corpus_totals(df, ["author"]).where("author = 'A'").first().tokens == 7


def test_ranks(spark):
    r = random.Random(1)
    rows = [(r.choice("aab"), r.randrange(5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {(x.g, x.i): x["rank"] for x in global_rank(df, ["v", "i"], within=["g"]).collect()}
    for g in "ab":
        want = sorted((v, i) for gg, v, i in rows if gg == g)
        assert [got[g, i] for _, i in want] == list(range(1, len(want) + 1))
    run = {(x.g, x.i): x.s for x in running_sum(df, F.col("v"), ["g"], ["v", "i"], "s").collect()}
    total = 0
    for v, i in sorted((v, i) for g, v, i in rows if g == "a"):
        total += v
        assert run["a", i] == total
    before = {(x.g, x.i): x.p for x in previous(df, F.col("i"), ["g"], ["v", "i"], "p").collect()}
    seq = [i for v, i in sorted((v, i) for g, v, i in rows if g == "a")]
    assert [before["a", i] for i in seq] == [None, *seq[:-1]]
    assert global_rank(df.where("i < 0"), ["v"]).count() == 0


def test_percentiles_break_ties_by_word(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 0), ("d", 9)], "w string, n long")
    assert {x.w: x.pct for x in percentile_ranks(df, "n", "w").collect()} == {"a": 1 / 3, "b": 2 / 3, "d": 1.0}


def test_numbers_are_kept(spark):
    known = spark.createDataFrame([("b", 7), ("x", 2)], "name string, number long")
    names = spark.createDataFrame([("c",), ("a",), ("b",), (None,), ("c",)], "name string")
    assert {x.name: x.number for x in new_numbers(known, names).collect()} == {"b": 7, "x": 2, "a": 8, "c": 9}


def test_keyed(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, None), ("a", 2, "x")], "k string, o int, v string")
    assert {tuple(x) for x in first_per_key(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", None, None)}
    assert {tuple(x) for x in last_per_key(df, ["k"], ["o"]).collect()} == {("a", 2, "x"), ("b", None, None)}
    assert {x.v for x in preferred_per_key(df, ["k"], F.col("v") == "x", ["o"]).collect()} == {"x", None}
    t = spark.createDataFrame([("șir", 1), ("tot", 2), ("țot", 3)], "w string, n int")
    q = spark.createDataFrame([("șir",), ("sir",), ("tot",), ("TOT",), ("x",)], "k string")
    from lexoria.functions.text import fold

    assert {x.k: x.n for x in lookup_two_tier(q, "k", t, "w", fold, ["n"]).collect()} == {"șir": 1, "sir": 1, "tot": 2, "TOT": None, "x": None}


def test_normalize_is_native_and_composes_as_unicode_does(spark):
    r = random.Random(3)
    letters = "abcsțiâăxyz AȘșȩ\u0331\u0323\u05b7\u0326\u0327\u0301\u0306\u0302\u0308\u030c\u05d1\n1|\u093c\u092fжй\u0938é"
    rows = [("".join(r.choice(letters) for _ in range(r.randrange(9))),) for _ in range(1500)] + [(None,), ("",), ("s\u0327",), ("e\u0302\u0301",)]
    df = spark.createDataFrame(rows, "s string").select("s", X.normalize("s").alias("n"))
    for x in df.collect():
        assert x.n == (None if x.s is None else unicodedata.normalize("NFC", x.s.lower().replace("ş", "ș").replace("ţ", "ț")))
    assert "Python" not in df._jdf.queryExecution().toString()
