"""Held-out items whose passages stand in documents.

The items are the indexed side: an inverted index with BM25 weights, its postings cut into blocks of
`BLOCK` items with the largest weight of each term in each block. Every document is cut into
overlapping passages, and every passage is a query:

- an item's threshold is the smallest score that any `run` consecutive words of it bring on their
  own, so a passage that holds such words scores at least that much and none is lost;
- the bounds are those of block-max WAND, taken for a whole batch of passages at once: the sum of
  the largest weights of `run` words in a row rules out passages, the sum of block maxima rules out
  blocks, and only what is left is scored from the postings;
- items at or above their threshold are verified: the same `run` consecutive words in passage and item.

Words are 64-bit numbers on both sides (see `wordcodes`). An index is made of items with at most
`PART_BYTES` bytes of text, so its size is bounded whatever an item's length; more items are taken
part by part: an index is built, sent, used for one pass over the corpus whose pairs are written, and
destroyed before the next is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexoria.llm.wordcodes import mix, word_codes
from lexoria.plans.runtime import publish

#: Bytes of items' texts in one index, which takes about eight times as many; more are taken in
#: further passes over the corpus.
PART_BYTES = 16 << 20
BLOCK = 64
PASSAGE = 24
#: Passages that are scored at once, and postings or runs that are looked at together.
PASSAGES, TOGETHER = 20_000, 1 << 21
#: Bytes of documents that are searched at once; a longer document is searched alone.
AT_ONCE = 2 << 20
K1, B = 1.2, 0.75


@dataclass
class Index:
    term: np.ndarray  # numbers of the words, rising; a term is its place here
    maybe: np.ndarray  # by a word's upper bits: whether any term has these
    ids: np.ndarray  # of items, by their place
    most: np.ndarray  # largest weight of each term
    cell: np.ndarray  # where the blocks of each term begin, and the end
    block: np.ndarray  # of each cell
    block_most: np.ndarray  # largest weight of the cell's term in its block
    start: np.ndarray  # where the postings of each cell begin, and the end
    place: np.ndarray  # postings: the item's place, rising within a term
    weight: np.ndarray
    need: np.ndarray  # threshold of each item, inf if it has too few words
    block_need: np.ndarray
    words: np.ndarray  # terms of all items one after another
    run_key: np.ndarray  # numbers of the runs of words, rising
    run_at: np.ndarray  # where the run begins in `words`
    run_item: np.ndarray  # and whose it is
    run: int

    def size(self) -> int:
        """Bytes of all arrays."""
        return sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray))

    def terms_of(self, numbers: np.ndarray) -> np.ndarray:
        """The term of each word, -1 for words of no item."""
        out = np.full(len(numbers), -1, np.int32)
        at = np.flatnonzero(self.maybe[(numbers >> np.uint64(44)).astype(np.int64)])
        if len(at):
            k = np.minimum(np.searchsorted(self.term, numbers[at]), len(self.term) - 1)
            out[at] = np.where(self.term[k] == numbers[at], k, -1)
        return out


def _run_keys(terms: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """A number for the `run` terms from each place on."""
    key = np.zeros(len(at), np.uint64)
    for k in range(run):
        key = mix(key ^ (terms[at + k].astype(np.uint64) + np.uint64(1))) if k else mix(terms[at].astype(np.uint64) + np.uint64(1))
    return key


def build_index(items: list[tuple[int, str | None]], run: int) -> Index:
    """Index of items (id, text); of repeated ids the first counts."""
    first: dict[int, str] = {}
    for i, text in items:
        first.setdefault(i, text or "")
    ids, n = np.array(list(first), np.int64), len(first)
    row, number = word_codes(pa.array(list(first.values()), pa.large_string()), True)
    term, words = np.unique(number, return_inverse=True)
    words, row = words.astype(np.int32), row.astype(np.int32)
    del number
    maybe = np.zeros(1 << 20, bool)
    maybe[(term >> np.uint64(44)).astype(np.int64)] = True
    v, blocks = max(1, len(term)), max(1, -(-n // BLOCK))
    length = np.bincount(row, minlength=n).astype(np.float64)
    mean = max(1.0, length.mean() if n else 1.0)
    # postings: (term, item) in order
    key, tf = np.unique(words.astype(np.int64) * max(1, n) + row, return_counts=True)
    t, p = (key // max(1, n)).astype(np.int32), (key % max(1, n)).astype(np.int32)
    df = np.bincount(t, minlength=v)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    w = (idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[p] / mean))).astype(np.float32)
    del tf
    edge = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (p[1:] // BLOCK != p[:-1] // BLOCK)])[: len(t)]
    block_most = np.maximum.reduceat(w, edge) if len(edge) else np.zeros(0, np.float32)
    cell = np.searchsorted(t[edge], np.arange(v + 1)).astype(np.int32)
    most = np.zeros(v, np.float32)
    np.maximum.at(most, t[edge], block_most)
    # runs of words within an item, and the smallest score that one brings
    at = np.flatnonzero(row[run - 1 :] == row[: len(row) - run + 1]).astype(np.int32) if len(row) >= run else np.zeros(0, np.int32)
    whose = row[at]
    need = np.full(n, np.inf)
    for lo in range(0, len(at), TOGETHER // run):
        a, i = at[lo : lo + TOGETHER // run], whose[lo : lo + TOGETHER // run]
        each = np.sort(words[a[:, None] + np.arange(run)], axis=1)
        mine = w[np.searchsorted(key, each.astype(np.int64) * max(1, n) + i[:, None])].astype(np.float64)
        mine[:, 1:][each[:, 1:] == each[:, :-1]] = 0  # a word twice counts once
        np.minimum.at(need, i, mine.sum(axis=1))
    del key
    need -= 1e-3  # sums come in another order and in single precision
    pad = np.full(blocks * BLOCK, np.inf)
    pad[:n] = need
    run_key = _run_keys(words, at, run)
    order = np.argsort(run_key)
    return Index(
        term, maybe, ids, most, cell, (p[edge] // BLOCK).astype(np.int32), block_most, np.r_[edge, len(t)].astype(np.int32), p, w, need,
        pad.reshape(blocks, BLOCK).min(1), words, run_key[order], at[order], whose[order], run,
    )


def _expand(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of each element of the slices."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner]


def _portions(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of at least one element, else with sizes that add up to at most `most`."""
    end, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, side="right")))
        yield slice(at, to)
        at = to


def search(index: Index, flat: np.ndarray, sizes: np.ndarray) -> tuple[set[tuple[int, int]], dict[str, int]]:
    """(document, item place) of each verified leak; what each step left. `flat`: terms of all documents."""
    passage, run = max(PASSAGE, 2 * index.run), index.run
    step, n = passage - run + 1, len(index.ids)
    begin = np.cumsum(sizes) - sizes
    count = np.where(sizes >= run, np.maximum(1, -(-(sizes - run + 1) // step)), 0)
    doc, at = _expand(np.zeros(len(sizes), np.int64), count)
    at = begin[doc] + at * step
    end = np.minimum(at + passage, (begin + sizes)[doc])
    seen = {"passages": len(at), "blocks scored": 0, "retrieved": 0}
    if not len(at) or not n or not np.isfinite(index.need).any():
        return set(), seen
    # 1. a passage is left if it has `run` words in a row that are all terms, with largest weights that
    # add up to the least threshold; by running sums
    total, gaps = np.zeros(len(flat) + 1), np.zeros(len(flat) + 1, np.int64)
    np.cumsum(np.where(flat >= 0, index.most[np.maximum(flat, 0)], np.float32(0)), out=total[1:], dtype=np.float64)
    np.cumsum(flat < 0, out=gaps[1:])
    good = (gaps[run:] == gaps[:-run]) & (total[run:] - total[:-run] >= index.need.min() - 1e-6)
    goods = np.r_[0, np.cumsum(good)]
    keep = goods[end - run + 1] > goods[at]
    doc, at, end = doc[keep], at[keep], end[keep]
    seen["after term bounds"] = len(at)
    blocks, found = len(index.block_need), set()
    for lo in range(0, len(at), PASSAGES):
        d, a, e = doc[lo : lo + PASSAGES], at[lo : lo + PASSAGES], end[lo : lo + PASSAGES]
        # 2. each distinct term of a passage once; sums of block maxima
        owner, pos = _expand(a, e - a)
        terms = flat[pos].astype(np.int64)
        both = np.unique((owner * len(index.term) + terms)[terms >= 0])
        owner, terms = both // len(index.term), both % len(index.term)
        for own in _by_owner(owner, index.cell[terms + 1] - index.cell[terms]):
            o, t = owner[own], terms[own]
            k, c = _expand(index.cell[t], index.cell[t + 1] - index.cell[t])
            low = int(o[0])
            key = (o[k] - low) * blocks + index.block[c]
            if (int(o[-1]) - low + 1) * blocks <= 4 * TOGETHER:
                sums = np.bincount(key, index.block_most[c], (int(o[-1]) - low + 1) * blocks)
                hit = np.flatnonzero(sums > 0)
                hit = hit[sums[hit] >= index.block_need[hit % blocks] - 1e-6]
            else:
                hit, inverse = np.unique(key, return_inverse=True)
                hit = hit[np.bincount(inverse, index.block_most[c]) >= index.block_need[hit % blocks] - 1e-6]
            seen["blocks scored"] += len(hit)
            if not len(hit):
                continue
            # 3. scores from the postings of what is left
            j = np.minimum(np.searchsorted(hit, key), len(hit) - 1)
            c = c[hit[j] == key]
            j = j[hit[j] == key]
            who, post = _expand(index.start[c], index.start[c + 1] - index.start[c])
            score = np.bincount(j[who] * BLOCK + index.place[post] % BLOCK, index.weight[post], len(hit) * BLOCK)
            item = (hit % blocks)[:, None] * BLOCK + np.arange(BLOCK)
            need = np.where(item < n, index.need[np.minimum(item, n - 1)], np.inf).ravel()
            got = np.flatnonzero(score >= need - 1e-6)
            seen["retrieved"] += len(got)
            if len(got):
                found |= _verified(index, flat, hit[got // BLOCK] // blocks + low, item.ravel()[got], d, a, e)
    return found, seen


def _by_owner(owner: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Slices of whole owners, whose sizes add up to about `TOGETHER`; an owner of its own may have more."""
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])[: len(owner)]
    if not len(edge):
        return
    bound = np.r_[edge, len(owner)]
    for s in _portions(np.add.reduceat(sizes, edge), TOGETHER):
        yield slice(bound[s.start], bound[s.stop])


def _verified(index: Index, flat: np.ndarray, who: np.ndarray, item: np.ndarray, d: np.ndarray, a: np.ndarray, e: np.ndarray) -> set[tuple[int, int]]:
    """4. Of the retrieved (passage, item) those with the same `run` consecutive words."""
    run, n, out = index.run, len(index.ids), set()
    wanted = np.unique(who * n + item)
    who = np.unique(who)
    _, at = _expand(a[who], e[who] - a[who] - run + 1)
    of = np.repeat(who, e[who] - a[who] - run + 1)
    known = np.r_[0, np.cumsum(flat < 0)]
    keep = known[at + run] == known[at]  # every word is a term
    of, at = of[keep], at[keep]
    key = _run_keys(flat, at, run)
    left, right = np.searchsorted(index.run_key, key), np.searchsorted(index.run_key, key, side="right")
    for s in _portions(right - left, TOGETHER // run):
        k, r = _expand(left[s], (right - left)[s])
        if not len(k):
            continue
        pas, here, there = of[s][k], at[s][k], index.run_at[r]
        whose = index.run_item[r]
        pair = pas * n + whose
        ok = wanted[np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)] == pair
        here, there, pas, whose = here[ok], there[ok], pas[ok], whose[ok]
        same = (flat[here[:, None] + np.arange(run)] == index.words[there[:, None] + np.arange(run)]).all(1)
        out.update(zip(d[pas[same]].tolist(), whose[same].tolist()))
    return out


def _parts(items: DataFrame, most: int) -> int:
    """Parts of the items, by hash of their ids, of about half of `most` bytes each."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    return 1 if total <= most else -(-2 * total // most)


def find_leaks(docs: DataFrame, items: DataFrame, run: int = 12, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id): documents and items that share `run` or more consecutive words.

    `docs`: doc_id, text; `items`: item_id, text; other columns are ignored. Words are runs of
    letters in lower case without diacritics; what stands between them doesn't matter. Null and short
    texts have no leaks; rows with a null id are left out; of repeated items the least text counts; a
    pair is given once however often its rows or its passages are repeated. Empty tables give no
    rows. Whole texts are searched. The result is a written table, whole when this returns.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    items = items.groupBy("item_id").agg(F.min("text").alias("text"))
    parts = _parts(items, part_bytes)
    if parts > 1:
        items = publish(items, "items")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    out = None
    for k in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        index = spark.sparkContext.broadcast(build_index([(r["item_id"], r["text"]) for r in mine.orderBy("item_id").collect()], run))

        def query(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for whole in batches:
                size = whole.column(1).cast(pa.large_string())
                for s in _portions(np.diff(np.frombuffer(size.buffers()[1], np.int64, len(size) + 1, size.offset * 8)), AT_ONCE):
                    b = whole.slice(s.start, s.stop - s.start)
                    row, number = word_codes(b.column(1), True)
                    found, _ = search(ix, ix.terms_of(number), np.bincount(row, minlength=b.num_rows))
                    if found:
                        ids = b.column(0).to_pylist()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[d] for d, _ in found], pa.int64()), pa.array([int(ix.ids[i]) for _, i in found], pa.int64())],
                            names=["doc_id", "item_id"],
                        )

        got = publish(rows.mapInArrow(query, "doc_id long, item_id long").distinct(), "leaks")
        index.destroy()
        out = got if out is None else out.unionByName(got)
    return out
