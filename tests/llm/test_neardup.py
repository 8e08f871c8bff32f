import random

import numpy as np
import pyarrow as pa
import pytest

from lexoria.llm import neardup
from lexoria.llm.neardup import _binary, _compare, _emit, _keys, _Order, _sets, _spread, copies, groups, near_duplicates, word_set

SCHEMA = "space string, id long, text string, node string"


def texts_of(seed):
    r = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "bcdfș" for b in "aeiă" for c in "lmnr"]
    rows, k = [], 0
    for _ in range(40):
        base = r.choices(vocab, k=r.randrange(8, 40))
        for _ in range(r.choice([1, 1, 3])):
            words = list(base)
            for _ in range(r.randrange(6)):
                words[r.randrange(len(words))] = r.choice(vocab)
            r.shuffle(words)
            k += 1
            rows.append((r.choice(["p", "q"]), k, " ".join(words).capitalize() + r.choice([".", " 1!"]), "x"))
    rows += [("p", 900 + i, "una doi trei patru cinci șase șapte opt nouă zece unsprezece doisprezece", "x") for i in range(20)]
    rows += [("p", 950, "una doi trei patru cinci șase șapte opt nouă zece unsprezece treisprezece", "x")]
    rows += [("p", 960, None, "x"), ("p", 961, "", "x"), ("p", None, "a b", "x"), ("q", 962, " ".join(vocab * 300), "x"), ("q", 963, " ".join(vocab * 200) + " y", "x")]
    return rows + r.sample(rows, 15)


def brute(rows):
    sets = {(s, i): word_set(t) for s, i, t, _ in rows if t and i is not None}
    keys = sorted(k for k, v in sets.items() if len(v) >= 12)
    return {(a[0], a[1], b[1]) for x, a in enumerate(keys) for b in keys[x + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("part", "listed"), [(8192, 1 << 18), (3, 1 << 18), (3, 5), (8192, 0), (2, 0)])
def test_every_pair_is_found(spark, part, listed, monkeypatch):
    monkeypatch.setattr(neardup, "LISTED", listed)
    monkeypatch.setattr(neardup, "COUNTED", 50 + listed)
    rows = texts_of(part)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), expand=100, part=part).collect()
    assert {(x.space, x.id_a, x.id_b) for x in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_many_copies_are_given_by_their_first(spark):
    rows = texts_of(1)
    got = {(x.space, x.id_a, x.id_b) for x in near_duplicates(spark.createDataFrame(rows, SCHEMA), expand=4).collect()}
    copies = set(range(900, 920))
    star = {("p", 900, i) for i in range(901, 920)}
    assert {p for p in got if p[1] in copies or p[2] in copies} == star | {("p", 900, 950)}
    assert got <= brute(rows)


def test_groups_and_links(spark):
    rows = texts_of(2)
    got = {(x.space, x.id): x for x in groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    text = {(s, i): t for s, i, t, _ in rows if i is not None}
    pairs = brute(rows)
    assert set(got) == {k for k, t in text.items() if len(word_set(t)) >= 12}
    for (s, i), x in got.items():
        mates = {text[s, b if a == i else a] for (z, a, b) in pairs if z == s and i in (a, b)} - {text[s, i]}
        assert x.links == len(mates)
        assert x.class_id == min([i, *(min(a, b) for (z, a, b) in pairs if z == s and got[z, a].class_id == x.class_id)])
    assert all(got[s, a].class_id == got[s, b].class_id for s, a, b in pairs)


def test_large_blocks_use_tiles(spark):
    base = [f"cuv{chr(97 + i)}" for i in range(14)]
    rows = [("p", i, " ".join([*base, *(chr(97 + i // 26**k % 26) * 3 for k in range(3))]), "") for i in range(700)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == len(brute(rows))


def test_a_repeated_id_counts_once(spark):
    a = "una doi trei patru cinci șase șapte opt nouă zece unsprezece doisprezece"
    rows = [("p", 1, a, ""), ("p", 1, a[::-1], ""), ("p", 2, a + " x", ""), ("p", 3, a[::-1] + " x", "")]
    got = {(x.id_a, x.id_b) for x in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got in ({(1, 2)}, {(1, 3)})


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).count() == 0 and groups(df).count() == 0


def test_copies(spark):
    rows = texts_of(4)
    text = {(s, i): t for s, i, t, _ in rows if i is not None and len(word_set(t)) >= 12}
    same = {}
    for (s, i), t in text.items():
        same.setdefault((s, t), []).append(i)
    got = {(x.space, x.id, x.rep, x.copies) for x in copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(s, i, min(ids), len(ids)) for (s, _), ids in same.items() if len(ids) > 1 for i in ids}


class Held:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("scale", [1, 1_000, 1_000_000])
def test_rows_a_text_stay_level_however_large_the_collection_is(scale):
    """Other texts come to a collection, with their own words and with the common ones of these texts: a
    text's rows go on meeting their own blocks only."""
    r = random.Random(7)
    common, rare = [f"com{a}{b}" for a in "abcdefgh" for b in "abcde"], [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "lmnr" for d in "aeiou"]
    texts = pa.array([" ".join(r.sample(common, 15) + r.sample(rare, 6)) for _ in range(400)])
    batch = pa.RecordBatch.from_arrays([pa.array(["p"] * 400), texts], names=["space", "text"])
    words, n = np.unique(np.concatenate([b.column("word").to_numpy() for b in _emit(12, 0.01, Held(_Order(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)), 8192)([batch])]), return_counts=True)
    n = np.where(n > 50, n * scale, n)  # the common words
    known = _Order(words.view(np.uint64), n, 1)
    rows = pa.Table.from_batches(_emit(12, 0.7, Held(known), 8192)([batch]))
    aside = rows.filter(pa.array(rows.column("part").to_numpy() < 0))
    block = dict(zip(*np.unique(aside.column("word").to_numpy(), return_counts=True)))
    parts = pa.array([-(-int(block[w]) // 8192) for w in aside.column("word").to_pylist()], pa.int32())
    spread = sum(b.num_rows for b in _spread(aside.append_column("parts", parts).to_batches())) if len(aside) else 0
    assert len(rows) - len(aside) + spread == len(rows) <= 8 * 400


def test_keys_are_of_128_bits():
    keys = np.array([[1, 2], [1, 3], [1 << 63, 0]], np.uint64)
    assert (_keys(_binary(keys)) == keys).all() and (_keys(_binary(keys).slice(1)) == keys[1:]).all()
    seen = neardup._Seen()
    assert seen.new(keys).all() and not seen.new(keys).any()


def test_tiles_of_other_population_counts_are_skipped(monkeypatch):
    """Equal sizes, but words that fall on the same bits: tiles are ruled out without a comparison."""
    lanes = np.zeros((600, 4), np.int64)
    lanes[300:] = -1
    t = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(600, np.int64)), pa.array(np.zeros(600, np.int32)), pa.array(np.full(600, 2, np.int32)), pa.array(np.r_[np.full(300, 100), np.full(300, 101)].astype(np.int32)),
         _binary(np.stack([np.arange(600), np.arange(600)], axis=1).astype(np.uint64)), *[pa.array(lanes[:, k].copy()) for k in range(4)]],
        names=["word", "part", "side", "n", "node", "b0", "b1", "b2", "b3"],
    )
    compared = []
    real = neardup._alike
    monkeypatch.setattr(neardup, "_alike", lambda n1, n2, x, y, t: compared.append(len(n1) * n2.shape[-1]) or real(n1, n2, x, y, t))
    got = sum(b.num_rows for b in _compare(0.7)([t]))
    assert got == 2 * (300 * 299 // 2) and sum(compared) < 600 * 600 / 2 + 256 * 256


def test_sets_are_those_of_the_words():
    texts = ["Unu doi doi TREI", None, "", "a b", "x²y ½ Ⅷ ș" * 3]
    rows, sizes, flat = _sets(pa.array(texts), 1)
    assert rows.tolist() == [0, 3, 4] and sizes.tolist() == [len(word_set(texts[i])) for i in (0, 3, 4)] and len(flat) == sizes.sum()
