import random

import numpy as np
import pyarrow as pa
import pytest

from lexoria.llm import terms
from lexoria.llm.terms import PLACES, _sum, dictionary, mark_terms, marked_terms, term_sums, term_totals

SCHEMA = "id long, word string, o long, d long, range string, term string"


def rows_of(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = "hot" if r.random() < 0.35 else r.choice([None, "", "Ab", "ab", "ab ", *(f"w{k}" for k in range(60)), "long" * 2000])
        rows.append((i, w, r.choice([None, 0, r.randrange(10**12), (1 << 60) // 3000]), r.choice([None, r.randrange(60_000)]), "r", "t"))
    return rows


def brute(rows):
    out = {}
    for _, w, o, d, *_ in {x[0]: x for x in rows}.values():
        if w is not None:
            a = out.setdefault(w, [0, 0, 0])
            a[0], a[1], a[2] = a[0] + (o or 0), a[1] + (d or 0), a[2] + 1
    return {w: tuple(a) for w, a in out.items()}


def test_against_brute_force(spark, monkeypatch):
    for block in (1 << 18, 7):
        monkeypatch.setattr(terms, "BLOCK", block)
        rows = rows_of(1500, block)
        df = spark.createDataFrame(rows + rows[:400], SCHEMA).repartition(6)
        got = term_totals(df, "word", "o", "d", "id").collect()
        assert {x.term: (x.occurrences, x.documents, x.rows) for x in got} == brute(rows)
        assert len({x.term_id for x in got}) == len(got) == len(brute(rows))


def test_small_batches_keep_places_apart(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = rows_of(500, 5)
        got = term_totals(spark.createDataFrame(rows, SCHEMA), "word", "o", "d", "id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x.term: (x.occurrences, x.documents, x.rows) for x in got} == brute(rows)
    assert len({x.term_id for x in got}) == len(got)


def test_marks_and_limits(spark):
    df = spark.createDataFrame([(1, "a", 5, 3), (2, "b", 4, 100_001), (3, "c", 9, 2), (4, "d", 10**6, 100_001), (5, "e", 10**6, 100_000)], "id long, word string, o long, d long")
    got = {x.term: x.mark for x in mark_terms(term_totals(df, "word", "o", "d", "id")).collect()}
    assert got == {"a": None, "b": "rare", "c": "rare", "d": "common", "e": None}
    assert term_totals(df.where("id > 9"), "word", "o", "d", "id").count() == 0


@pytest.mark.parametrize("range_terms", [1 << 16, 3])
def test_dictionary_comes_first_and_is_dense_in_each_range(spark, range_terms):
    rows = rows_of(900, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    known = {x.term: x.term_id for x in dictionary(df.select("word"), "word", range_terms).collect()}
    assert set(known) == set(brute(rows)) and len(set(known.values())) == len(known)
    ranges = {}
    for w, i in known.items():
        ranges.setdefault(i >> PLACES, []).append((i & ((1 << PLACES) - 1), w))
    for places in ranges.values():
        assert [p for p, _ in sorted(places)] == list(range(len(places)))
        assert [w for _, w in sorted(places)] == sorted((w for _, w in places), key=str.encode)


def test_sums_are_arrays_by_identifier(spark):
    rows = rows_of(900, 9)
    known, sums = term_sums(spark.createDataFrame(rows, SCHEMA), "word", "o", "d", "id")
    assert sums.columns == ["term_id", *terms.COUNTS]  # no strings until the end
    term = {x.term_id: x.term for x in known.collect()}
    assert {term[x.term_id]: (x.occurrences, x.documents, x.rows) for x in sums.collect()} == brute(rows)


def test_places_of_a_range_go_on_in_later_batches():
    batch = lambda ids, o: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(o), pa.array(o), pa.array(np.ones(len(o), np.int64))], names=["term_id", *terms.COUNTS])
    a, b = 5 << PLACES, 9 << PLACES
    got = pa.Table.from_batches(_sum([batch([a | 2, a, a | 2], [1, 2, 3]), batch([], np.zeros(0, np.int64)), batch([a | 2, b | 1], [10, 20])])).to_pydict()
    assert got["term_id"] == [a, a | 2, b | 1] and got["occurrences"] == [2, 14, 20] and got["rows"] == [1, 3, 1]


def test_marked_terms_are_those_marked(spark):
    df = spark.createDataFrame(rows_of(700, 10), SCHEMA)
    want = {(x.term, x.mark) for x in mark_terms(term_totals(df, "word", "o", "d", "id"), 10**6, 50_000).collect() if x.mark}
    assert {(x.term, x.mark) for x in marked_terms(df, "word", "o", "d", "id", rare_occurrences=10**6, rare_documents=50_000).collect()} == want != set()
