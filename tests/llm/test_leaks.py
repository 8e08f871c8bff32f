import random
import tracemalloc

import numpy as np
import pytest

import pyarrow as pa

from lexoria.llm import leaks
from lexoria.llm.leaks import build_index, find_leaks, search
from lexoria.llm.wordcodes import bare, word_codes, words_of as words

words_of = lambda text: words(text, True)

FOLD = str.maketrans("ăâîșțĂÂÎȘȚ", "aaistAAIST")


def test_words_without_diacritics():
    assert words_of("Șase-ŞAPTE, ţări 3a_b ș") == ["sase", "sapte", "tari", "a", "b", "s"]
    assert words_of(None) == words_of("") == words_of("12 - !") == []
    assert bare("Жй") == "Жи"


def corpus(seed):
    r = random.Random(seed)
    common = ["și", "de", "la", "cu", "în", "o"]
    vocab = common + [a + b + c for a in "bcdfgț" for b in "aeiăâ" for c in "lmnrș"]
    text = lambda n: r.choices(vocab, weights=[20] * 6 + [1] * (len(vocab) - 6), k=n)
    start = text(7)
    items = [(i, (start if i % 3 == 0 else []) + text(r.randrange(5, 50))) for i in range(150)]
    shared = text(15)
    items += [(200, text(5) + shared), (201, shared + text(3)), (202, text(11)), (203, [])]
    docs = []
    for d in range(120):
        words = text(r.randrange(0, 400))
        if r.random() < 0.6 and words:
            src = r.choice(items)[1]
            if src:
                a = r.randrange(len(src))
                at = r.randrange(len(words))
                words[at:at] = src[a : a + r.choice([8, 11, 12, 13, 20])]
        sep = r.choice([" ", ", ", " 12 ", "\n- "])
        words = [w.upper() if r.random() < 0.1 else w.translate(FOLD) if r.random() < 0.2 else w for w in words]
        docs.append((d, sep.join(words)))
    docs += [(500, None), (501, ""), (502, " ".join(shared)), (503, "de " * 50_000 + " ".join(shared)), (504, "și" * 200_000), (None, " ".join(shared))]
    return docs, [(i, " ".join(w)) for i, w in items] + [(202, "x"), (204, None), (None, "a b")]


def brute(docs, items, run=12):
    got, seen = set(), {}
    for i, t in items:
        if i is not None and t is not None:
            seen.setdefault(i, []).append(t)
    grams = {}
    for i, ts in seen.items():
        w = words_of(min(ts))
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    for d, t in docs:
        if d is not None:
            w = words_of(t)
            got |= {(d, i) for k in range(len(w) - run + 1) for i in grams.get(tuple(w[k : k + run]), ())}
    return got


@pytest.mark.parametrize(("most", "together"), [(20_000_000, 1 << 21), (40_000, 1 << 21), (20_000_000, 40)])
def test_against_brute_force(spark, most, together, monkeypatch):
    monkeypatch.setattr(leaks, "TOGETHER", together)
    docs, items = corpus(most)
    d = spark.createDataFrame([(*x, 1) for x in docs + docs[:9]], "doc_id long, text string, item_id int").repartition(5)
    got = find_leaks(d, spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string"), part_bytes=most).collect()
    assert {(x.doc_id, x.item_id) for x in got} == brute(docs, items)
    assert len(got) == len(brute(docs, items)) > 20


def test_bounds_leave_little(spark):
    docs, items = corpus(3)
    index = build_index([x for x in items if x[0] is not None and x[1]], 12)
    r = random.Random(4)
    docs += [(900 + k, " ".join(r.choice(["și", "de", "la", "zzz", "yyy", "xxx", "bel"]) for _ in range(300))) for k in range(20)]
    row, number = word_codes(pa.array([t or "" for _, t in docs]), True)
    found, seen = search(index, index.terms_of(number), np.bincount(row, minlength=len(docs)))
    assert found and seen["retrieved"] <= seen["blocks scored"] * 64 and seen["after term bounds"] < seen["passages"]


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(d, i).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), i).count() == 0


def test_large_index_is_bounded():
    """As many items as make up two parts, of 300 words each: measured size of the arrays of one part."""
    r = np.random.default_rng(1)
    vocab = np.array(["".join(x) for x in r.choice(list("abcdefgilmnoprstuvăâîșț"), (120_000, 6))])
    items = [(i, " ".join(vocab[(r.random(300) ** 3 * len(vocab)).astype(int)])) for i in range(20_000)]
    total = sum(len(t.encode()) for _, t in items)
    part = items[: int(len(items) * leaks.PART_BYTES / total)]
    tracemalloc.start()
    index = build_index(part, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert index.size() < 250 << 20 and peak < 500 << 20, (index.size() >> 20, peak >> 20)
    assert total / leaks.PART_BYTES > 2
    row, number = word_codes(pa.array([part[7][1], "x " * 50, part[9][1][500:1500]]), True)
    found, _ = search(index, index.terms_of(number), np.bincount(row, minlength=3))
    assert found == {(0, 7), (2, 9)}


def test_many_items_with_one_beginning(spark):
    start = "alege cuvântul care se potrivește cel mai bine în locul gol din propoziție acum"
    items = [(i, f"{start} x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}y") for i in range(3000)]
    docs = spark.createDataFrame([(1, "zzz " + start), (2, "nimic " * 30), (3, start[:40])], "doc_id long, text string")
    got = find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == 3000 and {x.doc_id for x in got} == {1}
