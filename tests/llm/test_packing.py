import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lexoria.llm import packing
from lexoria.llm.packing import count_tokens, pack, plan_rows

PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def check_plan(counts, capacity):
    plan = plan_rows(counts, capacity)
    laid = Counter()
    for n, combo in plan:
        assert n > 0 and sum(k * c for k, c in combo) <= capacity
        for k, c in combo:
            laid[k] += n * c
    assert laid == Counter({k: v for k, v in counts.items() if k and v})
    return sum(n for n, _ in plan), plan


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 60), max_size=25))
def test_plans_lay_every_piece_once(counts):
    rows, _ = check_plan(counts, 40)
    total = sum(k * v for k, v in counts.items())
    assert rows <= 2 * -(-total // 40)


def test_every_exact_complement_is_used():
    """After the exact steps no row's gap can be filled by one, two or three pieces left over."""
    r = random.Random(5)
    for _ in range(30):
        counts = {r.randrange(1, 60): r.randrange(1, 6) for _ in range(12)}
        sums = packing._Sums(list(counts), 60)
        for gap in range(1, 60):
            have = sorted(counts, reverse=True)
            want = {(gap,)} & {(k,) for k in have}
            want |= {(a, b) for a in have for b in have if a >= b and a + b == gap}
            want |= {(a, b, c) for a in have for b in have for c in have if a >= b >= c and a + b + c == gap}
            assert set(sums.fills(gap)) == want
        gone = r.choice(list(counts))
        sums.drop(gone)
        for gap in range(1, 60):
            assert all(gone not in f for f in sums.fills(gap)) and sums.pairs[gap] == len(list(sums._two(gap)))


def test_plans_are_tight_and_short():
    r = random.Random(1)
    counts = Counter(min(2048, int(r.lognormvariate(5.5, 1))) + 1 for _ in range(60_000))
    counts.pop(2049, None)
    total = sum(k * v for k, v in counts.items())
    rows, plan = check_plan(counts, 2048)
    assert rows <= total / 2048 * 1.005 + 1
    more, plan2 = check_plan({k: v * 1_000_000 for k, v in counts.items()}, 2048)
    assert len(plan2) <= len(plan) * 1.5 + 2048 and more <= rows * 1_000_000


def whole(text):
    return len(packing._encoding(PATH).encode_ordinary(text))


@settings(max_examples=60, deadline=None)
@given(st.text("aăZ19 \n\t'.|,-\x1c\x85\xa0漢。字ж're\u0301²", max_size=400), st.sampled_from([2, 5, 20]))
def test_cuts_change_no_count(text, long):
    old, packing.LONG = packing.LONG, long
    try:
        assert "".join(packing._safe_cuts(text)) == text
        assert count_tokens([text], PATH) == [whole(text)]
    finally:
        packing.LONG = old


def test_long_texts_are_measured_as_a_whole():
    r = random.Random(2)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = [
        pick("0123456789", 200_000), pick("漢字日本語文章。", 150_000), pick("abcdefgh", 200_000), "a" * 150_000, "|" * 150_000, " " * 150_000 + "x",
        pick("ab12", 200_000), pick("กขคงจ", 100_000), "x'" * 80_000, " ".join(pick("abcșț", 5) for _ in range(40_000)), pick("\x1cа漢", 90_000),
    ]
    assert count_tokens(texts, PATH) == [whole(t) for t in texts]
    assert count_tokens([None, "", "<|endoftext|>"], PATH)[:2] == [0, 0]
    assert sum(1 for _ in packing._safe_cuts(texts[6])) > 2 and sum(1 for _ in packing._safe_cuts(texts[1])) > 2


def test_rows(spark):
    r = random.Random(3)
    texts = [" ".join(["cuvânt"] * r.choice([0, 1, 3, 30, 300, 900])) for _ in range(300)] + [None, "", " " * 300_000, "a" * 300_000, "ă b " * 40_000]
    docs = [(i, t, 5, "n") for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs + docs[:20] + [(None, "x", 0, "")], "doc_id long, text string, n int, part string").repartition(5)
    got = pack(df, PATH, 512).collect()
    want = dict(enumerate(count_tokens(texts, PATH)))
    fill, pieces = Counter(), {}
    for x in got:
        fill[x.row_id] += x.n_tokens
        pieces.setdefault(x.doc_id, []).append((x.piece, x.start, x.n_tokens))
    assert set(pieces) == set(want) and max(fill.values()) <= 512
    for d, ps in pieces.items():
        ps.sort()
        assert sum(n for *_, n in ps) == want[d] and len(ps) == max(1, -(-want[d] // 512))
        assert [(p, s) for p, s, _ in ps] == [(k, k * 512) for k in range(len(ps))]
    assert set(fill) == set(range(len(fill)))
    assert len(fill) <= sum(want.values()) / 512 * 1.05 + 2


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    only = pack(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), PATH).collect()
    assert {(x.doc_id, x.n_tokens, x.row_id) for x in only} == {(1, 0, 0), (2, 0, 0)}
