"""Words of texts as 64-bit numbers, found by numpy on code-point arrays without a string per word.

A word is a maximal run of letters of any script, in lower case; with `bare` diacritics are taken off
letters first and combining marks fall out. A word's number is a polynomial of its letters' random
numbers, mixed, so equal words have equal numbers and different ones differ but for a chance of 2^-64.

Characters whose lower case or bare form isn't one character of its own (such as the capital sigma,
whose small form depends on its place) take the row that they are in through strings, `words_of`;
the numbers are the same.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

N = sys.maxunicode + 1
#: Code points that are handled at once.
BLOCK = 1 << 18
MARK = np.uint64(1)
BASE = 0x9E3779B97F4A7C55
_RUN = re.compile(r"[^\W\d_]+")


def mix(x: np.ndarray, first: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    """Scatter 64-bit numbers; one to one."""
    x = x.copy()
    for shift, by in ((33, first), (29, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(32))


def _is_mark(ch: str) -> bool:
    return unicodedata.combining(ch) != 0 or unicodedata.category(ch) == "Mn"


def bare(text: str) -> str:
    """Without diacritics, composed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not _is_mark(c)))


def words_of(text: str | None, plain: bool = False) -> list[str]:
    """The words in their order; with `plain` without diacritics."""
    if not text:
        return []
    text = text.lower()
    out = []
    for run in _RUN.findall(bare(text) if plain else text):
        # the pattern also takes characters that count without being digits, such as ² and Ⅷ
        out += [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
    return out


class _Tables:
    """`value`: 0 for what parts words, 1 for a mark that falls out, else a letter's random number, odd
    for characters that take their row through strings."""

    def __init__(self, plain: bool) -> None:
        to, hard = np.zeros(N, np.int64), np.zeros(N, bool)
        marks = []
        for cp in range(N):
            ch = chr(cp)
            if not ch.isalpha():
                if plain and 0x300 <= cp and _is_mark(ch):
                    marks.append(cp)
                continue
            if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3 or cp >= 0x20000:
                to[cp] = cp  # neither case nor diacritics
                if cp >= 0x2F800 and plain:
                    to[cp] = ord(bare(ch)[0])
                continue
            low = ch.lower()
            low = bare(low) if plain else low
            hard[cp] = len(low) != 1 or cp == 0x3A3 or plain and 0x1100 <= cp <= 0x11FF or not low.isalpha()
            to[cp] = cp if hard[cp] else ord(low)
        # letters: above 1, odd if hard
        letters = (mix(to.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(2)) & ~np.uint64(1) | hard.astype(np.uint64)
        self.value = np.where(to > 0, letters, np.uint64(0))
        self.value[marks] = MARK
        self.marks = bool(marks)
        self.power = self.undo = np.ones(1, np.uint64)

    def powers(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the polynomial's base and of its inverse, at least so many."""
        if len(self.power) < most:
            both = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                factor = np.full(most, base, np.uint64)
                factor[0] = 1
                both.append(np.multiply.accumulate(factor))
            self.power, self.undo = both
        return self.power, self.undo


@lru_cache(2)
def _tables(plain: bool) -> _Tables:
    return _Tables(plain)


def _block(t: _Tables, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in `value`, and their numbers; `first` marks the first character of each row.

    A word's sum is the difference of two running sums, brought back to its beginning.
    """
    if not len(value):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, undo = t.powers(max(BLOCK, len(value)))
    letter = value > MARK
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | first[1:]
    ends[:-1] &= ~letter[1:] | first[1:]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends)
    total = value * power[: len(value)]
    whole = np.cumsum(total, dtype=np.uint64)
    return at, mix((whole[to] - whole[at] + total[at]) * undo[at])


def codes_of_words(words: list[str], plain: bool = False) -> np.ndarray:
    """The number of each word as `words_of` gives it."""
    if not words:
        return np.zeros(0, np.uint64)
    t = _tables(plain)
    cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(cp) + 1, bool)
    first[np.cumsum([0, *map(len, words)])] = True
    return _block(t, t.value[cp], first[:-1])[1]


def word_codes(column: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of every word of a string column, in order; null rows have none."""
    t = _tables(plain)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    start = off - off[0]
    if len(cp) != len(raw):
        start = np.r_[0, np.cumsum(pc.utf8_length(column).to_numpy())]
    rows, numbers = [], []
    hard: set[int] = set()
    s = 0
    while s < len(cp):
        width = BLOCK
        while True:  # cut after a character that parts words
            e = min(s + width, len(cp))
            value = t.value[cp[s:e]]
            if e == len(cp):
                break
            tail = 1024
            while not len(gaps := np.flatnonzero(value[-tail:] == 0)) and tail < len(value):
                tail *= 8
            if len(gaps):
                e -= min(tail, len(value)) - int(gaps[-1]) - 1
                value = value[: e - s]
                break
            width *= 2
        is_hard = (value & MARK) > (value == MARK)
        if is_hard.any():
            hard.update(np.unique(np.searchsorted(start, s + np.flatnonzero(is_hard), side="right") - 1).tolist())
        lo, hi = np.searchsorted(start, (s, e), side="left")
        first = np.zeros(e - s + 1, bool)
        first[start[lo:hi] - s] = True
        place = None
        if t.marks:
            keep = value != MARK
            if not keep.all():
                # a row's first character may be a mark: what is left of the row begins after it
                begin = np.r_[0, np.cumsum(keep)][start[lo:hi] - s]
                place = np.flatnonzero(keep)
                value = value[keep]
                first = np.zeros(len(value) + 1, bool)
                first[begin] = True
        at, h = _block(t, value, first[: len(value)])
        if place is not None:
            at = place[at]
        rows.append(np.searchsorted(start, s + at, side="right") - 1)
        numbers.append(h)
        s = e
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    number = np.concatenate(numbers) if numbers else np.zeros(0, np.uint64)
    if hard:
        keep = ~np.isin(row, np.fromiter(hard, np.int64))
        extra = {r: codes_of_words(words_of(column[r].as_py(), plain), plain) for r in hard}
        row = np.concatenate([row[keep], *[np.full(len(c), r) for r, c in extra.items()]])
        number = np.concatenate([number[keep], *extra.values()])
        order = np.argsort(row, kind="stable")
        row, number = row[order], number[order]
    return row.astype(np.int64), number
