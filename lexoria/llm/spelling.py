"""One consistent form for text that looks the same but is typed in other characters.

A batch of Arrow strings is decoded once into an array of code points with an array of row numbers.
Everything after that is gathers from lookup tables over all code points: invisible characters fall
out, characters with an expansion are written at offsets found by a running sum, letters are taken
apart into base and marks, look-alike letters become Latin, and marks are composed again by lookups
of (base, mark) in a sorted array. No string function is called per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N = 0x110000
# Cyrillic and Greek letters that look like Latin ones, in the order of the alphabet.
LOOK_ALIKE = {
    "а": "a", "ɑ": "a", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ı": "i", "ј": "j", "ӏ": "l",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ӏ": "I",
    "α": "a", "ι": "i", "ϳ": "j", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ϲ": "c",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
# Hyphens that look like the plain one.
HYPHENS = [0x2010, 0x2011, 0x2012, 0x2212, 0xFE63, 0xFF0D]
# Invisible characters besides those of the format category.
INVISIBLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
BREVE, CARON, CEDILLA, COMMA, HYPHEN, BLANK = 0x306, 0x30C, 0x327, 0x326, 0x2D, 0x20
OTHER, CYRILLIC, LATIN = 0, 1, 2


class Tables:
    """Lookup tables over all code points, built from the Unicode data of Python."""

    def __init__(self) -> None:
        self.drop = np.zeros(N, bool)
        self.space = np.zeros(N, bool)
        self.ccc = np.zeros(N, np.uint8)
        self.script = np.zeros(N, np.uint8)
        like = np.arange(N, dtype=np.uint32)
        expand: dict[int, list[int]] = {}
        firsts, pairs = [], []
        for cp in range(N):
            if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp < 0xE0000 or cp >= 0xE0200:
                continue
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cat == "Cn":
                continue
            if cat == "Cf" or (cat == "Cc" and not ch.isspace()):
                self.drop[cp] = True
                continue
            if cat[0] == "Z" or ch.isspace():
                self.space[cp] = True
                continue
            self.ccc[cp] = unicodedata.combining(ch)
            whole = unicodedata.normalize("NFD", ch)
            tag = unicodedata.decomposition(ch).partition(" ")[0]
            if tag in ("<wide>", "<narrow>", "<font>") or tag == "<compat>" and (
                cat == "Nl" and cp >= 0x2160 or 0xFB00 <= cp <= 0xFB06 and cp != 0xFB05
            ):
                whole = unicodedata.normalize("NFKD", ch)
            if len(whole) == 2 and unicodedata.normalize("NFC", whole) == ch:
                firsts.append(cp)
                pairs.append((ord(whole[0]), ord(whole[1])))
            elif len(whole) > 2 and unicodedata.normalize("NFC", whole) == ch:  # composed from a composed letter
                one = [ord(c) for c in unicodedata.normalize("NFC", whole[:-1])]
                if len(one) == 1:
                    firsts.append(cp)
                    pairs.append((one[0], ord(whole[-1])))
            if whole != ch:
                expand[cp] = [ord(c) for c in whole]
            name = unicodedata.name(ch, "") if cat[0] == "L" else ""
            self.script[cp] = CYRILLIC if name.startswith("CYRILLIC") else LATIN if name.startswith("LATIN") else OTHER
        for a, b in INVISIBLE:
            self.drop[a : b + 1] = True
            self.ccc[a : b + 1] = 0
        for a, b in LOOK_ALIKE.items():
            like[ord(a)] = ord(b)
        for h in HYPHENS:
            like[h] = HYPHEN
            expand.pop(h, None)
        self.like = like
        # expansions: the code points of all of them in one array, found by start and length
        self.length = np.ones(N, np.uint8)
        self.start = np.zeros(N, np.uint32)
        flat = [0]
        for cp, to in expand.items():
            self.start[cp], self.length[cp] = len(flat), len(to)
            flat += to
        self.flat = np.array(flat, np.uint32)
        self.expands = self.start > 0
        key = np.array([(a << 21) | b for a, b in pairs], np.uint64)
        order = np.argsort(key)
        self.pair_key, self.pair_to = key[order], np.array(firsts, np.uint32)[order]

    def compose(self, base: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The composed letters, 0 where there is none."""
        key = (base.astype(np.uint64) << np.uint64(21)) | mark.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_to[at], 0).astype(np.uint32)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows and the row number of each; null rows have none."""
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)  # the bytes where a code point begins
    row = np.searchsorted(off[1:] - off[0], starts, side="right")
    return cp, row.astype(np.int64)


def _strings(cp: np.ndarray, row: np.ndarray, n: int, valid: np.ndarray) -> pa.Array:
    raw = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    off = np.zeros(n + 1, np.int64)
    off[1:] = np.cumsum(np.bincount(row, width, n)).astype(np.int64)
    nulls = pa.array(valid).buffers()[1]
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(off), pa.py_buffer(raw), nulls).cast(pa.string())


def clean_array(column: pa.Array) -> pa.Array:
    """The consistent form of each string of an Arrow array; nulls stay null."""
    t = tables()
    n = len(column)
    valid = np.asarray(column.is_valid())
    cp, row = _points(column)
    keep = ~t.drop[cp]
    cp, row = cp[keep], row[keep]
    # expansion: a running sum of lengths gives the place of each character's first code point
    size = t.length[cp].astype(np.int64)
    if len(cp) and size.max() > 1 or t.expands[cp].any():
        end = np.cumsum(size)
        inner = np.arange(end[-1]) - np.repeat(end - size, size)
        src = np.repeat(cp, size)
        cp = np.where(t.expands[src], t.flat[np.minimum(t.start[src] + inner, len(t.flat) - 1)], src)
        row = np.repeat(row, size)
    cp = np.where(t.space[cp], BLANK, cp)
    # words: runs between blanks and hyphens. One with Cyrillic letters only stays as it is, unless all
    # of its letters look Latin and the string has, or gets, Latin letters in other words
    like, script = t.like[cp], t.script[cp]
    edge = (cp == BLANK) | (like == HYPHEN)
    word = np.cumsum(edge | np.r_[True, row[1:] != row[:-1]][: len(cp)]) if len(cp) else np.zeros(0, np.int64)
    k = int(word[-1]) + 1 if len(cp) else 0
    letter = (t.ccc[cp] == 0) & ~edge
    in_word = lambda mask: np.bincount(word, mask, k)[word] > 0 if k else mask
    true_cyrillic = (script == CYRILLIC) & (like == cp)
    only_cyrillic = in_word(script == CYRILLIC) & ~in_word(letter & (script != CYRILLIC))
    latin = (script == LATIN) | (letter & (like != cp) & ~only_cyrillic)  # those that are or become so
    row_latin = (np.bincount(row, latin, n)[row] > 0) if n else latin
    stays = only_cyrillic & (in_word(true_cyrillic) | ~row_latin) & ~edge
    cp = np.where(stays, cp, like)
    # marks that belong to Romanian letters: the comma below for s and t, the breve for a; then marks in
    # their canonical order: by class, in the run of marks after a letter
    if len(cp) > 1:
        own = (t.ccc[cp] > 0) & np.r_[False, row[1:] == row[:-1]]
        run = np.maximum.accumulate(np.where(own, 0, np.arange(len(cp))))
        base = cp[run] | 0x20
        cp = np.where(own & (cp == CEDILLA) & ((base == ord("s")) | (base == ord("t"))), COMMA, cp)
        cp = np.where(own & (cp == CARON) & (base == ord("a")), BREVE, cp)
        ccc = t.ccc[cp]
        if (own[1:] & (ccc[:-1] > ccc[1:])).any():
            cp = cp[np.lexsort((ccc, run))]
    # composition: the first marks of all letters at once, then the second ones and so on. A mark that
    # stays keeps later ones of its own class, or a lower one, from the letter
    if len(cp) > 1:
        ccc = t.ccc[cp].astype(np.int16)
        own = (ccc > 0) & np.r_[False, row[1:] == row[:-1]]
        letter_at = np.maximum.accumulate(np.where(own, 0, np.arange(len(cp))))
        nth = np.arange(len(cp)) - letter_at
        cp, left, kept = cp.copy(), np.ones(len(cp), bool), np.zeros(len(cp), np.int16)
        marks = np.flatnonzero(nth > 0)
        marks = marks[np.argsort(nth[marks], kind="stable")]
        for at in np.split(marks, np.flatnonzero(np.diff(nth[marks])) + 1) if len(marks) else []:
            base = letter_at[at]
            to = np.where((ccc[at] > kept[base]) & (ccc[base] == 0), t.compose(cp[base], cp[at]), 0)
            yes = to > 0
            cp[base[yes]] = to[yes]
            left[at[yes]] = False
            kept[base[~yes]] = ccc[at[~yes]]
        cp, row = cp[left], row[left]
    # single blanks, none at the ends
    if len(cp):
        blank = cp == BLANK
        first = np.r_[True, row[1:] != row[:-1]]
        solid = blank & (first | np.r_[False, blank[:-1]])
        cp, row = cp[~solid], row[~solid]
        if len(cp):
            last = np.r_[row[1:] != row[:-1], True]
            tail = (cp == BLANK) & last
            cp, row = cp[~tail], row[~tail]
    return _strings(cp, row, n, valid)


def clean_rows(df: DataFrame, key: str, text: str, changed_only: bool = False) -> DataFrame:
    """(key, clean) for each row; with `changed_only` just the rows whose text isn't clean.

    Nulls stay null and never count as changed; an empty text, and one of blanks or invisible
    characters alone, gives ''. Order, repeated rows and other columns play no part.
    """
    kind = df.schema[key].dataType
    arrow = pa.int32() if kind.simpleString() == "int" else pa.string() if kind.simpleString() == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in batches:
            ids, old = b.column(0).cast(arrow), b.column(1)
            new = clean_array(old)
            out = pa.RecordBatch.from_arrays([ids, new], names=["key", "clean"])
            yield out.filter(pc.fill_null(pc.not_equal(new, old.cast(pa.string())), False)) if changed_only else out

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"key {kind.simpleString()}, clean string")
