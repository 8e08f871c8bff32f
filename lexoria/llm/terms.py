"""Totals of every distinct term over the whole collection, and which terms are too rare or too common.

1. The global dictionary: every distinct term gets an integer, `range << 32 | place`. A term's hash
   names its range, of which there are as many as the number of terms asks for, and its place is that
   among the range's sorted terms. The dictionary is written before anything is counted.
2. Rows are counted in blocks: each input partition adds its rows up in arrays by a code of its own, so
   that a term with a third of all rows leaves a block once; the block's terms are then encoded by the
   global dictionary, and only integers go on.
3. Each range of identifiers has arrays of counts indexed by place; the blocks' counts are added to them,
   batch by batch. Strings come back by identifier at the end, for the terms that are asked for.

Sums are of 64-bit integers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexoria.plans.runtime import publish, shuffle_width

#: Distinct terms that a block holds before its counts are handed on.
BLOCK = 1 << 18
#: Distinct terms of a range, on average.
RANGE_TERMS = 1 << 16
COUNTS = ("occurrences", "documents", "rows")
COUNT_ROWS = "occurrences long, documents long, rows long"
PLACES = 32


class _Block:
    """A block's own dictionary and its arrays of counts by code."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.sums = [np.zeros(1024, np.int64) for _ in COUNTS]

    def add(self, terms: pa.Array, values: list[np.ndarray]) -> None:
        enc = terms.dictionary_encode()
        local = enc.indices.to_numpy(zero_copy_only=False)
        code, get = self.code, self.code.setdefault
        glob = np.fromiter((get(w, len(code)) for w in enc.dictionary.to_pylist()), np.int64, len(enc.dictionary))
        need = len(code)
        for k, v in enumerate(values):
            if need > len(self.sums[k]):
                self.sums[k] = np.concatenate([self.sums[k], np.zeros(max(need, len(self.sums[k])), np.int64)])
            part = np.zeros(len(glob), np.int64)
            np.add.at(part, local, v)
            self.sums[k][glob] += part

    def batches(self, step: int = 50_000) -> Iterator[tuple[list[str], list[np.ndarray]]]:
        words = list(self.code)
        for i in range(0, len(words), step):
            yield words[i : i + step], [s[i : i + step][: len(words) - i] for s in self.sums]


def _values(b: pa.RecordBatch, first: int) -> list[np.ndarray]:
    return [b.column(first + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(COUNTS))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each block's terms, once per block and term."""
    names, block = ["term", *COUNTS], _Block()

    def out() -> Iterator[pa.RecordBatch]:
        for words, sums in block.batches():
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *map(pa.array, sums)], names=names)

    for b in batches:
        block.add(b.column(0), _values(b, 1))
        if len(block.code) > BLOCK:
            yield from out()
            block = _Block()
    yield from out()


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifiers of distinct terms, which come in order of (range, term)."""
    now, place = None, 0
    for b in batches:
        at = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(at):
            continue
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        local = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
        if at[0] == now:
            local[: begin[1] if len(begin) > 1 else None] += place
        now, place = at[-1], local[-1] + 1
        yield pa.RecordBatch.from_arrays([pa.array((at << PLACES) | local), b.column(1)], names=["term_id", "term"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by identifier, which come in order of their ranges: one array per range and count, indexed by place."""
    now, sums = None, [np.zeros(0, np.int64) for _ in COUNTS]

    def out() -> Iterator[pa.RecordBatch]:
        there = np.flatnonzero(sums[-1])  # of every term in a range at least one row counts
        for i in range(0, len(there), 50_000):
            k = there[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array((now << PLACES) | k), *[pa.array(s[k]) for s in sums]], names=["term_id", *COUNTS])

    for b in batches:
        ident = b.column(0).to_numpy(zero_copy_only=False)
        values = _values(b, 1)
        at, place = ident >> PLACES, ident & ((1 << PLACES) - 1)
        edge = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]])[: len(at)], len(at)]
        for lo, hi in zip(edge[:-1], edge[1:]):
            if at[lo] != now:
                if now is not None:
                    yield from out()
                now, sums = int(at[lo]), [np.zeros(0, np.int64) for _ in COUNTS]
            p = place[lo:hi]
            need = int(p.max()) + 1
            for k, v in enumerate(values):
                if need > len(sums[k]):
                    sums[k] = np.concatenate([sums[k], np.zeros(max(need, 2 * len(sums[k])) - len(sums[k]), np.int64)])
                np.add.at(sums[k], p, v[lo:hi])
    if now is not None:
        yield from out()


def _counted(rows: DataFrame, term: str, occurrences: str, documents: str, key: str | None) -> DataFrame:
    """(term, occurrences, documents, rows) of each block."""
    df = rows.select(
        *([F.col(f"`{key}`").alias("k")] if key else []),
        F.col(f"`{term}`").alias("term"),
        F.coalesce(F.col(f"`{occurrences}`").cast("long"), F.lit(0)).alias("o"),
        F.coalesce(F.col(f"`{documents}`").cast("long"), F.lit(0)).alias("d"),
    )
    if key:
        df = df.where("k is not null").groupBy("k").agg(F.min(F.struct("term", "o", "d")).alias("r")).select("r.*")
    df = df.where("term is not null").select("term", "o", "d", F.lit(1).cast("long").alias("n"))
    return df.mapInArrow(_count, f"term string, {COUNT_ROWS}")


def dictionary(terms: DataFrame, term: str = "term", range_terms: int = RANGE_TERMS) -> DataFrame:
    """(term_id, term): an integer for every distinct term of a table, as a written table. Nulls have none."""
    width = shuffle_width(terms.sparkSession)
    ranges = max(width, -(-terms.count() // range_terms))
    ranged = terms.where(F.col(term).isNotNull()).select(F.pmod(F.xxhash64(term), F.lit(ranges)).alias("range"), F.col(term).alias("term"))
    # terms are made distinct where they are and again in their range
    ranged = ranged.groupBy("range", "term").agg(F.lit(1).alias("_one")).select("range", "term")
    return publish(ranged.repartition(width, "range").sortWithinPartitions("range", "term").mapInArrow(_place, "term_id long, term string"), "dictionary")


def term_sums(rows: DataFrame, term: str, occurrences: str, documents: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The dictionary (term_id, term) and the totals (term_id, occurrences, documents, rows)."""
    blocks = publish(_counted(rows, term, occurrences, documents, key), "blocks")
    known = dictionary(blocks)
    encoded = blocks.join(known, "term").select("term_id", *COUNTS)
    at = F.shiftright("term_id", PLACES)
    ranged = encoded.repartition(shuffle_width(rows.sparkSession), at).sortWithinPartitions(at)
    return known, ranged.mapInArrow(_sum, f"term_id long, {COUNT_ROWS}")


def term_totals(rows: DataFrame, term: str, occurrences: str, documents: str, key: str | None = None) -> DataFrame:
    """(term_id, term, occurrences, documents, rows): one row per distinct term, exactly as stored.

    Rows with a null term are left out, null counts are 0, '' is a term. Rows that repeat `key` count
    once, by the smallest (term, occurrences, documents) of them, and rows with a null key not at all;
    without `key` every row counts. An empty table gives no rows; other columns are ignored.
    """
    known, sums = term_sums(rows, term, occurrences, documents, key)
    return sums.join(known, "term_id").select("term_id", "term", *COUNTS)


def marked_terms(rows: DataFrame, term: str, occurrences: str, documents: str, key: str | None = None, **limits) -> DataFrame:
    """The rows of `term_totals` that `mark_terms` marks, with `mark`; strings are looked up for these only."""
    known, sums = term_sums(rows, term, occurrences, documents, key)
    return mark_terms(sums, **limits).where("mark is not null").join(known, "term_id").select("term_id", "term", *COUNTS, "mark")


def mark_terms(totals: DataFrame, rare_occurrences: int = 5, rare_documents: int = 3, common_documents: int = 100_000) -> DataFrame:
    """`totals` with `mark`: 'rare' below either lower limit, else 'common' above the upper one, else null."""
    return totals.withColumn(
        "mark",
        F.when((F.col("occurrences") < rare_occurrences) | (F.col("documents") < rare_documents), "rare").when(
            F.col("documents") > common_documents, "common"
        ),
    )
