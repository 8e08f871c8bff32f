import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexoria.llm import wordcodes
from lexoria.llm.wordcodes import codes_of_words, word_codes, words_of

ALPHABET = "aAbZșȘşțăÂîéİΣσςßﬁ̆̂̈12²½Ⅷ_ -\n\t'жЖ漢가ᄀ각ーʼªष्कि😀"


def check(texts, plain):
    row, number = word_codes(pa.array(texts, pa.string()), plain)
    want = [(i, h) for i, t in enumerate(texts) for h in codes_of_words(words_of(t, plain), plain).tolist()]
    assert list(zip(row.tolist(), number.tolist())) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=14)), max_size=7), st.booleans())
def test_same_words_as_by_strings(texts, plain):
    check(texts, plain)


def test_blocks_end_between_words(monkeypatch):
    texts = ["Ana are mere", None, "", "ă" * 900, "b", "c", " de la ", "x̆y z" * 40, "fără Σας", "12", "q"]
    for block in (1, 2, 7, 1 << 18):
        monkeypatch.setattr(wordcodes, "BLOCK", block)
        for plain in (False, True):
            check(texts, plain)
            row, _ = word_codes(pa.array(["", *texts, "z"]).slice(1, len(texts)), plain)
            assert row.tolist() == [i for i, t in enumerate(texts) for _ in words_of(t, plain)]


def test_every_letter_counts():
    words = [a + b + c for a in "aăbș" for b in ("", "a", "ab", "ba", "z") for c in "xyzж"]
    codes = codes_of_words(words)
    assert len(set(codes.tolist())) == len(set(words))


@pytest.mark.parametrize("plain", [False, True])
def test_long_texts(plain):
    check(["a" * 300_000, "și de " * 50_000, "|" * 300_000 + "a"], plain)
