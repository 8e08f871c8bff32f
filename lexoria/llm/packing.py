"""Texts measured in tokens, laid into rows of fixed capacity with little room left over.

The lengths of all pieces, at most `capacity` different ones, are counted by the cluster; the plan is
made on those counts alone, so its size doesn't depend on the number of texts:

1. the sums of singles and pairs of lengths are indexed, those of triples as a single and the indexed
   pairs of the rest; the longest remaining length leaves a gap, and the combinations under its exact
   complement are used up, as many rows at once as the counts allow of each;
2. what has no exact complement is laid by best fit: the longest first, each into the row with the
   smallest gap that takes it, again for whole counts at a time.

Each step uses up a length or a kind of row, so the plan has a few thousand lines at most. Pieces
get their rank among those of their length from counts by partition, without a sort or a group of
all pieces of a length, and the plan turns (length, rank) into the row.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexoria.plans.runtime import broadcast_within, publish

#: Code points about which a text goes to the tokenizer at once; see `_safe_cuts`.
LONG = 1 << 16
#: Bytes of offsets, one row for each partition and length, up to which they are broadcast.
OFFSET_BYTES = 32 << 20


@lru_cache(2)
def _encoding(path: str):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("rows", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _boundaries():
    """Where every piece of the tokenizer's pattern ends: no piece goes on into white space, or from a
    letter, a digit or a sign into another of these kinds, but for an apostrophe before letters."""
    import regex

    signs = r"!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
    return (
        regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n\r\t])"),
        regex.compile(rf"(?<=\p{{L}})(?=[0-9{signs}])|(?<=[0-9])(?=[A-Za-z{signs}])|(?<=[{signs}])(?=[0-9])"),
    )


def _safe_cuts(text: str) -> Iterator[str]:
    """The text in parts of about LONG code points that are tokenized alike on their own: cut only where
    a piece of the tokenizer's pattern ends. A stretch without such a place stays whole, however long."""
    at = 0
    while len(text) - at > LONG:
        cut = None
        for kind in _boundaries():
            m = kind.search(text, at + LONG // 2, min(len(text), at + LONG + 1))
            if m:
                cut = m.start()
                break
        if cut is None:  # none near: the next one of any kind, or the end
            cut = min((m.start() for kind in _boundaries() if (m := kind.search(text, at + LONG))), default=len(text))
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each whole text; 0 for null and empty ones."""
    enc = _encoding(path)
    return [sum(len(enc.encode_ordinary(p)) for p in _safe_cuts(t)) if t else 0 for t in texts]


class _Sums:
    """Lengths that are there, indexed by the sums of one and of two of them."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.capacity, n = capacity, np.array(sorted(lengths), np.int64)
        self.have = np.zeros(capacity + 1, bool)
        self.have[n] = True
        i, j = np.tril_indices(len(n))
        total = n[i] + n[j]
        fits = total <= capacity
        longer, total = n[i][fits], total[fits]
        order = np.lexsort((-longer, total))
        self.longer = longer[order].astype(np.int32)  # of each pair, by sum, the longest first
        self.start = np.searchsorted(total[order], np.arange(capacity + 2))
        self.pairs = np.bincount(total, minlength=capacity + 1)  # how many pairs there are of each sum

    def drop(self, k: int) -> None:
        """A length is used up."""
        if 2 * k <= self.capacity:
            self.pairs[2 * k] -= 1
        self.have[k] = False
        self.pairs[k + np.flatnonzero(self.have[: self.capacity - k + 1])] -= 1

    def _two(self, total: int) -> Iterator[tuple[int, int]]:
        if self.pairs[total]:
            a = self.longer[self.start[total] : self.start[total + 1]]
            for x in a[self.have[a] & self.have[total - a]].tolist():
                yield x, total - x

    def fills(self, gap: int) -> Iterator[tuple[int, ...]]:
        """Singles, pairs and triples of exactly this sum, the longest piece first. What was passed over
        stays impossible, as counts only fall, so every combination is gone through once."""
        if self.have[gap]:
            yield (gap,)
        yield from self._two(gap)
        first = np.flatnonzero(self.have[:gap])
        for a in first[self.pairs[gap - first] > 0][::-1].tolist():
            for b, c in self._two(gap - a) if self.have[a] else ():
                if not self.have[a]:
                    break
                if b <= a and self.have[b] and self.have[c]:
                    yield a, b, c


def plan_rows(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Kinds of rows: (how many, ((length, pieces of it in each such row), ...)), all pieces laid."""
    left = {k: v for k, v in counts.items() if 0 < k <= capacity and v}
    rows: list[tuple[int, Counter]] = []
    residual: dict[int, int] = {}
    sums = _Sums(list(left), capacity)
    for top in sorted(left, reverse=True):
        fills = iter([()]) if top == capacity else sums.fills(capacity - top)
        while top in left:
            fill = next(fills, None)
            if fill is None:
                residual[top] = left.pop(top)
                sums.drop(top)
                break
            combo = Counter((top, *fill))
            n = min(left.get(k, 0) // c for k, c in combo.items())
            if n:
                rows.append((n, combo))
                for k, c in combo.items():
                    left[k] -= c * n
                    if not left[k]:
                        del left[k]
                        sums.drop(k)
    # best fit: open kinds of rows by their gap
    open_rows: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(gap: int, row: list) -> None:
        if gap not in open_rows:
            insort(gaps, gap)
        open_rows.setdefault(gap, []).append(row)

    for k in sorted(residual, reverse=True):
        n = residual[k]
        while n:
            i = bisect_left(gaps, k)
            if i == len(gaps):
                per = capacity // k
                full, rest = divmod(n, per)
                if full:
                    put(capacity - per * k, [full, Counter({k: per})])
                if rest:
                    put(capacity - rest * k, [1, Counter({k: rest})])
                break
            gap = gaps[i]
            row = open_rows[gap].pop()
            if not open_rows[gap]:
                del open_rows[gap]
                gaps.pop(i)
            per = min(gap // k, n)
            m = min(row[0], n // per)
            if m < row[0]:
                put(gap, [row[0] - m, row[1]])
            put(gap - per * k, [m, row[1] + Counter({k: per})])
            n -= per * m
    rows += [(n, c) for group in open_rows.values() for n, c in group]
    return [(n, tuple(sorted(c.items(), reverse=True))) for n, c in rows]


def _layout(plan: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the ranks at which a kind of row begins, its first row, pieces in a row."""
    at, rank, out = 0, Counter(), {}
    for n, combo in plan:
        for k, c in combo:
            out.setdefault(k, []).append((rank[k], at, c))
            rank[k] += n * c
        at += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in out.items()}


def _number(capacity: int):
    """Pieces of each text, ranked among those of their length in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, used = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            ids, n = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            pieces = np.maximum(1, -(-n // capacity))
            owner = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(n[owner] - piece * capacity, capacity)
            order = np.argsort(size, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(size[order]) > 0])[: len(order)]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.repeat(edge, np.diff(np.r_[edge, len(order)]))
            rank += used[size]
            used += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner]), pa.array(piece.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.full(len(owner), part, np.int32)), pa.array(rank)],
                names=["doc_id", "piece", "n_tokens", "part", "rank"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, n_tokens, row_id): the row of each document, or of each of its pieces.

    Only a text over `capacity` tokens is split, into pieces of `capacity` and a last one of the rest;
    `start` is the piece's first token. No row holds more than `capacity` tokens, rows are numbered
    from 0 without gaps. A null or empty text has one piece of 0 tokens and takes its place in some
    row, dealt out evenly (row 0 if there are no others). Rows that repeat a doc_id count once, by the
    largest text; a null doc_id is left out; other columns are ignored. `tokenizer`: path of a file of
    token ranks that every executor can read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count_tokens(b.column(1).to_pylist(), tokenizer), pa.int64())], names=["doc_id", "n"])

    sized = rows.mapInArrow(measure, "doc_id long, n long").groupBy("doc_id").agg(F.max("n").alias("n"))
    # written once, so that ranks stay what they were when they were counted
    pieces = publish(sized.mapInArrow(_number(capacity), "doc_id long, piece int, n_tokens int, part int, rank long"), "pieces")
    counts = publish(pieces.groupBy("part", "n_tokens").agg(F.count("*").alias("c")), "counts")
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "n_tokens", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    totals = {r["n_tokens"]: r["c"] for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}
    plan = plan_rows(totals, capacity)
    n_rows = max(1, sum(n for n, _ in plan))
    shared = spark.sparkContext.broadcast(_layout(plan))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        for b in batches:
            size, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            row = rank % n_rows
            order = np.argsort(size, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
                if size[at[0]]:
                    begin, base, per = layout[int(size[at[0]])]
                    j = np.searchsorted(begin, rank[at], side="right") - 1
                    row[at] = base[j] + (rank[at] - begin[j]) // per[j]
            start = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64) * capacity
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(start), b.column(2), pa.array(row)], names=["doc_id", "piece", "start", "n_tokens", "row_id"])

    ranked = pieces.join(broadcast_within(publish(offsets, "offsets"), OFFSET_BYTES), ["part", "n_tokens"])
    ranked = ranked.select("doc_id", "piece", "n_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, n_tokens int, row_id long")
