"""Orders, tops and limits that are operations of their own."""

import os

import pytest
from oracle import DATA

from lexoria.plans.queries_serving import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_each_is_its_own(spark):
    assert len({QUERIES[f"srt_0{k}"] for k in (4, 5, 6, 8)}) == 4
    places = sorted((r.place, r.seam) for r in QUERIES["srt_05"](spark, DATA).collect())
    assert [p for p, _ in places] == list(range(1, len(places) + 1)) and [s for _, s in places] == sorted((s for _, s in places), reverse=True)
    assert {r.result for r in QUERIES["srt_06"](spark, DATA).collect()} >= {"occurrences", "documents"}
    assert {r.taken for r in QUERIES["srt_08"](spark, DATA).collect()} == {"after", "before"}
