"""Pairs of texts that share most of their words, and the groups they form.

Texts are compared as sets of distinct words; a pair counts if the words in both are at least
`threshold` of the words in either. No such pair is lost:

1. Words are counted exactly and ordered from rare to common. Two sets that are alike enough share a
   word among the first ``n - ceil(threshold * n) + 1`` of each, so sets meet in the blocks of those
   words. Only the `LISTED` most frequent words go to the tasks with their counts; all others come
   before them, in the order of their numbers (any order that all sets share will do).
2. A block's sets are sorted by size and compared tile by tile as bitmaps of 256 bits: exclusive-or
   and bit counts. A bit that differs takes a word that differs, so more differing bits than the
   radius ``(1 - t) / (1 + t) * (n + m)`` rule a pair out for certain; so does a difference in size.
   Tiles whose sizes or population counts all differ by more are skipped whole.
3. Pairs that are left are checked on the words themselves.

Equal sets are one node, named by 128 bits: a partition hands each on once, however many copies it
has. A word's block is no larger than its count. Blocks of words with a count over `PART` may be too
large for a task: their rows are set aside, counted exactly by word, and the sets of blocks that are
too large indeed are spread over parts of which every two meet in a task of their own. So only rows
of such blocks are repeated, as often as their own block asks for, whatever the collection's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexoria.llm.wordcodes import mix, word_codes, words_of
from lexoria.operators.components import connected_components
from lexoria.plans.runtime import broadcast_within, discard, publish, shuffle_width

BITS = 256
#: Words whose counts are sent to every task at most, 16 bytes each.
LISTED = 1 << 18
#: Words that a partition counts before it hands their counts on.
COUNTED = 1 << 21
#: Sets of one block that meet in one task at most, twice as many where two parts meet.
PART = 8192
TILE = 256
#: Sets whose rows go to one task of blocks on average, and tasks at most.
SETS_A_TASK, TASKS = 30_000, 200_000
#: Copies of one text up to which each takes part by itself; of more, the first stands for all.
EXPAND = 8
#: For `expand`: copies are paired one by one however many there are.
EVERY = 1 << 62
#: Bytes of candidates' keys up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Rows of texts that are taken apart at once.
ROWS = 4096


class _Seen:
    """Which keys of a batch a partition hasn't had yet; forgets when full, so that a key may come again."""

    def __init__(self, most: int = 1 << 19) -> None:
        self.keys: set[bytes] = set()
        self.most = most

    def new(self, keys: np.ndarray) -> np.ndarray:
        if len(self.keys) > self.most:
            self.keys.clear()
        out = np.zeros(len(keys), bool)
        for i, k in enumerate(keys.view("V16").ravel().tolist()):
            if k not in self.keys:
                self.keys.add(k)
                out[i] = True
        return out


def word_set(text: str | None) -> set[str]:
    """Distinct words: maximal runs of letters of any script, in lower case."""
    return set(words_of(text))


def _number(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _sets(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with enough words, their sizes, and the numbers of their distinct words in one array, rising
    within a row."""
    row, word = word_codes(texts)
    order = np.argsort(word)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")] if len(texts) <= 1 << 16 else np.lexsort((word, row))
    row, word = row[order], word[order]
    new = np.r_[True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])][: len(row)]
    row, word = row[new], word[new]
    sizes = np.bincount(row, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    enough = sizes >= least
    return np.flatnonzero(enough), sizes[enough], word[enough[row]] if len(row) else word


def _spaces(names: pa.Array) -> np.ndarray:
    """A number of each row's space, by which words and nodes of different spaces are told apart."""
    names = names.dictionary_encode()
    known = np.array([_number(f"\x00{x}") for x in names.dictionary.to_pylist()] or [0], np.uint64)
    return known[names.indices.to_numpy(zero_copy_only=False)]


def _set_keys(space: np.ndarray, owner: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each set of a space: mixed words added up in two ways, so that words' order
    plays no part."""
    out = np.stack([mix(space), mix(~space)], axis=1)
    if len(flat):
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        word = flat ^ space[owner]
        out[:, 0] += np.add.reduceat(mix(word), begin)
        out[:, 1] += np.add.reduceat(mix(word, 0xBF58476D1CE4E5B9), begin)
    return out


def _binary(keys: np.ndarray) -> pa.Array:
    """Keys as binary values of 16 bytes."""
    off = np.arange(len(keys) + 1, dtype=np.int32) * 16
    return pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(keys).tobytes())])


def _keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """What `_binary` was given."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        if len(c):
            c = c.cast(pa.binary())
            at = int(np.frombuffer(c.buffers()[1], np.int32, 1, c.offset * 4)[0])
            parts.append(np.frombuffer(c.buffers()[2], np.uint64, 2 * len(c), at).reshape(-1, 2))
    return np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)


class _Counts:
    """How many sets of a partition have each word."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, words: np.ndarray) -> None:
        got = np.unique(words, return_counts=True)
        self.parts.append(got)
        self.held += len(got[0])
        if self.held > COUNTED:
            self.merge()

    def merge(self) -> None:
        words, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(words)
        words, n = words[order], n[order]
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        self.parts = [(words[first], np.add.reduceat(n, first))]
        self.held = len(first)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.merge()
        out, self.parts, self.held = self.parts[0], [], 0
        return out


FIRST = "space string, id long, node binary, copy long, word long, n long"


def _first_pass(least: int):
    """Of each partition its rows with enough words (space, id, node, copy), and how many of its sets have
    each word (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        counts, seen = _Counts(), _Seen()
        names = ["space", "id", "node", "copy", "word", "n"]

        def counted() -> Iterator[pa.RecordBatch]:
            words, n = counts.take()
            for i in range(0, len(words), 100_000):
                w = words[i : i + 100_000]
                none = [pa.nulls(len(w), t) for t in (pa.string(), pa.int64(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(w.view(np.int64)), pa.array(n[i : i + 100_000])], names=names)

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                rows, sizes, flat = _sets(b.column(2), least)
                if not len(rows):
                    continue
                take = pa.array(rows)
                space, owner = _spaces(b.column(0).take(take)), np.repeat(np.arange(len(rows)), sizes)
                nodes = _set_keys(space, owner, flat)
                # equal sets of a partition meet others once, and count once
                counts.add(mix(flat ^ space[owner])[seen.new(nodes)[owner]])
                same = [xxhash.xxh3_64_intdigest(x.as_buffer()) for x in b.column(2).take(take).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), _binary(nodes), pa.array(np.array(same, np.uint64).view(np.int64)),
                     pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())],
                    names=names,
                )
                if counts.held > COUNTED:
                    yield from counted()
        yield from counted()

    return run


class _Order:
    """The counts of the most frequent words; of any other word no more than `rest` sets have it."""

    def __init__(self, words: np.ndarray, n: np.ndarray, rest: int) -> None:
        order = np.argsort(words)
        self.words, self.n, self.rest = words[order], n[order], rest

    def counts(self, words: np.ndarray) -> np.ndarray:
        """The count of each word, 0 if it isn't listed. `words` should rise, for speed."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.n[at], 0)


def _word_order(first: DataFrame, listed: int) -> _Order:
    """Exact counts of all words, of which the most frequent ones, at most `listed`, come to the driver."""
    step = F.floor(F.log2("n") * 8).alias("step")
    counts = publish(first.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("step", step), "words")
    steps = sorted(((r["step"], r["k"], r["most"]) for r in counts.groupBy("step").agg(F.count("*").alias("k"), F.max("n").alias("most")).collect()), reverse=True)
    low, left, rest = None, listed, 1
    for s, k, most in steps:
        if k > left:
            rest = most
            break
        low, left = s, left - k
    got = counts.where(F.col("step") >= low if low is not None else F.lit(False)).select("word", "n").toArrow()
    discard(counts)
    return _Order(got.column("word").to_numpy().view(np.uint64), got.column("n").to_numpy(), rest)


def _bitmaps(rows: int, owner: np.ndarray, flat: np.ndarray) -> np.ndarray:
    bits = np.zeros((rows, BITS), bool)
    bits[owner, (flat >> np.uint64(40)).astype(np.int64) % BITS] = True
    return np.packbits(bits, axis=1).view(np.int64)


LANES = [f"b{k}" for k in range(BITS // 64)]
LANE_ROWS = ", ".join(f"{c} long" for c in LANES)
BLOCK_ROWS = f"word long, part int, side int, n int, node binary, {LANE_ROWS}"
FOUND = f"a binary, b binary, word long, n int, node binary, {LANE_ROWS}"


def _emit(least: int, threshold: float, order, part: int):
    """The blocks that each set of a partition meets others in; equal sets of a partition go once.

    Rows of words that more than `part` sets have, or may have, are to be set aside; they have a part
    below 0, by which they are only strewn over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = order.value, _Seen()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                rows, sizes, flat = _sets(b.column(1), least)
                if not len(rows):
                    continue
                space = _spaces(b.column(0).take(pa.array(rows)))
                owner = np.repeat(np.arange(len(rows)), sizes)
                keys = _set_keys(space, owner, flat)
                new = seen.new(keys)
                if not new.any():
                    continue
                bits = _bitmaps(len(rows), owner, flat)
                word = mix(flat ^ space[owner])
                by_word = np.argsort(word, kind="stable")
                count = known.counts(word[by_word])
                by_count = by_word[np.argsort(owner[by_word].astype(np.int64) << 50 | np.minimum(count, (1 << 50) - 1), kind="stable")]
                many = np.empty(len(word), np.int64)
                many[by_word] = count
                rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
                take = by_count[(rank < prefix[owner]) & new[owner]]
                who, many = owner[take], many[take]
                many = np.where(many > 0, many, known.rest)
                strewn = np.minimum(-(-many // part), 1 << 16).astype(np.uint64)
                aside = -1 - (keys[who, 0] % strewn).astype(np.int64)
                lanes = bits[who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word[take].view(np.int64)), pa.array(np.where(many > part, aside, 0).astype(np.int32)), pa.array(np.full(len(who), 2, np.int32)),
                     pa.array(sizes[who].astype(np.int32)), _binary(keys[who]), *[pa.array(lanes[:, k]) for k in range(len(LANES))]],
                    names=["word", "part", "side", "n", "node", *LANES],
                )

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (word, n, node, lanes, parts) for the tasks of every two parts of their block: a set of
    part i goes to those of (i, j) for every j."""
    for whole in batches:
        at = 0
        many = whole.column("parts").to_numpy(zero_copy_only=False).astype(np.int64)
        while at < len(many):
            to = max(at + 1, int(np.searchsorted(np.cumsum(many[at:]), 200_000)) + at)
            b, parts = whole.slice(at, to - at), many[at:to]
            at = to
            mine = (_keys(b.column("node"))[:, 1] % parts.astype(np.uint64)).astype(np.int64)
            rep = np.repeat(np.arange(len(parts)), parts)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
            low, high = np.minimum(mine[rep], other), np.maximum(mine[rep], other)
            side = np.where(low == high, 2, (mine[rep] != low).astype(np.int64))
            take = pa.array(rep)
            yield pa.RecordBatch.from_arrays(
                [b.column("word").take(take), pa.array((low * parts[rep] + high).astype(np.int32)), pa.array(side.astype(np.int32)),
                 b.column("n").take(take), b.column("node").take(take), *[b.column(c).take(take) for c in LANES]],
                names=["word", "part", "side", "n", "node", *LANES],
            )


def _alike(n1, n2, x, y, threshold: float) -> np.ndarray:
    """Which pairs of bitmaps may be alike; a necessary test."""
    radius = (n1 + n2) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= radius


def _compare(threshold: float):
    """Candidate pairs of each block, and the rows set aside as they are; rows come in order of
    (word, part, n).

    A block of up to `TILE` sets is one tile; such tiles are compared many at once, diagonal by diagonal.
    """

    def tiles(n: np.ndarray, side: np.ndarray, node: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        edge = np.arange(0, len(n), TILE)
        fewest, most = np.minimum.reduceat(ones, edge), np.maximum.reduceat(ones, edge)
        for i in range(0, len(n), TILE):
            a = slice(i, i + TILE)
            for j in range(i, len(n), TILE):
                c = slice(j, j + TILE)
                if n[a][-1] < threshold * n[j] - 1e-9:
                    break  # sizes rise: all later tiles differ by more
                apart = max(fewest[j // TILE] - most[i // TILE], fewest[i // TILE] - most[j // TILE])
                if apart > (n[a][-1] + n[c][-1]) * ((1 - threshold) / (1 + threshold)) + 1e-6:
                    continue  # population counts all differ by more than the radius
                ok = _alike(n[a][:, None], n[c][None, :], bits[a][:, None, :], bits[c][None, :, :], threshold)
                ok &= (side[a][:, None] != side[c][None, :]) | (side[a][:, None] == 2)
                ok &= (node[a][:, None, :] != node[c][None, :, :]).any(-1)
                if i == j:
                    ok = np.triu(ok, 1)
                u, v = np.nonzero(ok)
                if len(u):
                    yield node[a][u], node[c][v]

    names = ["a", "b", "word", "n", "node", *LANES]

    def pairs(a: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        swap = ((a[:, 0] > c[:, 0]) | (a[:, 0] == c[:, 0]) & (a[:, 1] > c[:, 1]))[:, None]
        a, c = np.where(swap, c, a), np.where(swap, a, c)
        mixed = mix(a[:, 0]) ^ c[:, 0]
        order = np.argsort(mixed)
        same = np.r_[False, (mixed[order][1:] == mixed[order][:-1]) & (a[order][1:] == a[order][:-1]).all(1) & (c[order][1:] == c[order][:-1]).all(1)][: len(a)]
        keep = order[~same]
        none = [pa.nulls(len(keep), t) for t in (pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * len(LANES))]
        return pa.RecordBatch.from_arrays([_binary(a[keep]), _binary(c[keep]), *none], names=names)

    def process(t: pa.Table) -> Iterator[pa.RecordBatch]:
        aside = t.column("part").to_numpy() < 0
        if aside.any():
            for b in t.filter(pa.array(aside)).to_batches():
                none = pa.nulls(b.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([none, none, *[b.column(c) for c in names[2:]]], names=names)
            t = t.filter(pa.array(~aside))
            if not len(t):
                return
        word, part, side, n = (t.column(k).to_numpy() for k in range(4))
        node = _keys(t.column("node"))
        n = n.astype(np.int64)
        bits = np.stack([t.column(c).to_numpy() for c in LANES], axis=1).view(np.uint64)
        edge = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[edge, len(t)])
        # small blocks together: every row with the next of its block, with the next but one and so on
        block_end = np.repeat(np.where(size <= TILE, edge + size, 0), size)
        at, shift, u, v = np.flatnonzero(block_end > np.arange(len(t)) + 1), 1, [], []
        while len(at):
            to = at + shift
            ok = n[at] >= threshold * n[to] - 1e-9
            at, to = at[ok], to[ok]
            ok = _alike(n[at], n[to], bits[at], bits[to], threshold) & (node[at] != node[to]).any(1) & ((side[at] != side[to]) | (side[at] == 2))
            u.append(node[at[ok]]), v.append(node[to[ok]])
            shift += 1
            at = at[at + shift < block_end[at]]
        if u:
            yield pairs(np.concatenate(u), np.concatenate(v))
        for g in np.flatnonzero(size > TILE):
            s = slice(edge[g], edge[g] + size[g])
            for a, c in tiles(n[s], side[s], node[s], bits[s]):
                yield pairs(a, c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            # the last block may go on in the next batch
            w, p = t.column("word").to_numpy(), t.column("part").to_numpy()
            same = (w == w[-1]) & (p == p[-1]) if len(t) else np.zeros(0, bool)
            cut = len(t) - int(np.argmin(same[::-1])) if len(t) and not same.all() else 0
            if cut:
                yield from process(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and len(held):
            yield from process(held)

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each candidate; a row whose text isn't the one that its id stands for gives nothing."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            rows, sizes, flat = _sets(b.column(2), 1)
            keys = _set_keys(_spaces(b.column(1).take(pa.array(rows))), np.repeat(np.arange(len(rows)), sizes), flat)
            same = (keys == _keys(b.column(0).take(pa.array(rows)))).all(1)
            off = np.r_[0, np.cumsum(sizes[same])].astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(off), pa.array(flat[np.repeat(same, sizes)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([_binary(keys[same]), words], names=["node", "words"])


def _members(first: DataFrame) -> DataFrame:
    """(space, id, node, copy, rep, copies): one row per id; `rep` is the smallest id with the same text."""
    single = first.where("word is null").groupBy("space", "id").agg(F.max(F.struct("node", "copy")).alias("r")).select("space", "id", "r.node", "r.copy")
    single = publish(single, "single")
    classes = single.groupBy("node", "copy").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = publish(single.join(classes, ["node", "copy"]), "members")
    discard(single)
    return members


def _given(texts: DataFrame) -> DataFrame:
    return texts.select("space", F.col("id").cast("long").alias("id"), "text").where("space is not null and id is not null and text is not null")


def _candidates(texts: DataFrame, first: DataFrame, threshold: float, least: int, part: int) -> DataFrame:
    """(a, b): pairs of nodes that may be alike."""
    spark = texts.sparkSession
    order = spark.sparkContext.broadcast(_word_order(first, LISTED))
    width = max(shuffle_width(spark), min(TASKS, -(-first.where("word is null").count() // SETS_A_TASK)))
    blocks = texts.select("space", "text").mapInArrow(_emit(least, threshold, order, part), BLOCK_ROWS)
    meet = lambda rows: (
        rows.repartition(width, "word", "part").sortWithinPartitions("word", "part", "n").mapInArrow(_compare(threshold), FOUND)
    )
    met = publish(meet(blocks), "met")
    order.destroy()
    pairs, aside = met.where("a is not null").select("a", "b"), met.where("word is not null").drop("a", "b")
    if not aside.isEmpty():
        sizes = aside.groupBy("word").count().where(F.col("count") > part).select("word", F.ceil(F.col("count") / part).cast("int").alias("parts"))
        spread = aside.join(broadcast_within(publish(sizes, "sizes"), BROADCAST_BYTES), "word", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        pairs = pairs.unionByName(meet(spread.mapInArrow(_spread, BLOCK_ROWS)).select("a", "b"))
    candidates = publish(pairs.distinct(), "candidates")
    discard(met)
    return candidates


def alike_sets(texts: DataFrame, threshold: float = 0.7, least: int = 12, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Members (space, id, node, copy, rep, copies) and pairs (a, b) of different nodes.

    `texts`: space, id, text. A node is a set of words of a space; `rep` is the smallest id with the
    same text.
    """
    texts = _given(texts)
    first = publish(texts.mapInArrow(_first_pass(least), FIRST), "sets")
    members = _members(first)
    candidates = _candidates(texts, first, threshold, least, part)
    discard(first)
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = members.groupBy("node").agg(F.min(F.struct("rep", "space")).alias("r")).select("node", F.col("r.space").alias("space"), F.col("r.rep").alias("id"))
    ids = publish(wanted.join(one, "node"), "wanted")
    words = texts.join(broadcast_within(ids, BROADCAST_BYTES), ["space", "id"]).select("node", "space", "text")
    words = words.mapInArrow(_words, "node binary, words array<long>").dropDuplicates(["node"])
    wa = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    wb = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    pairs = (
        candidates.join(wa, "a").join(wb, "b").withColumn("n", F.size(F.array_intersect("wa", "wb")))
        .where(F.col("n") >= F.lit(threshold) * (F.size("wa") + F.size("wb") - F.col("n")) - 1e-9).select("a", "b")
    )
    pairs = publish(pairs, "pairs")
    discard(candidates)
    discard(ids)
    return members, pairs


def _links(members: DataFrame, pairs: DataFrame, expand: int) -> tuple[DataFrame, DataFrame]:
    units = members.where((F.col("copies") <= expand) | (F.col("id") == F.col("rep"))).select("space", "node", "id")
    ua = units.select("space", F.col("node").alias("a"), F.col("id").alias("x"))
    ub = units.select(F.col("node").alias("b"), F.col("id").alias("y"))
    across = pairs.join(ua, "a").join(ub, "b").select("space", "x", "y")
    mates = units.join(units.select("node", F.col("id").alias("y")), "node").where("id < y").select("space", F.col("id").alias("x"), "y")
    stars = members.where((F.col("copies") > expand) & (F.col("id") != F.col("rep"))).select("space", F.col("rep").alias("x"), F.col("id").alias("y"))
    return across.unionByName(mates), stars


def near_duplicates(texts: DataFrame, threshold: float = 0.7, least: int = 12, expand: int = EXPAND, part: int = PART) -> DataFrame:
    """(space, id_a, id_b), id_a < id_b: the pairs of rows of one space that share most of their words.

    `texts`: space, id, text; further columns are ignored. Texts of fewer than `least` distinct
    words, null ones and rows without space or id take no part; rows that repeat an id count once
    (the largest of its texts' keys). Every pair of different texts is given. Copies of one text are
    paired with each other and with all its mates too, unless there are more than `expand` of them:
    then the first stands for the others, each of which is paired with it. An empty table gives no
    rows.
    """
    links, stars = _links(*alike_sets(texts, threshold, least, part), expand)
    every = links.unionByName(stars)
    return every.select("space", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(texts: DataFrame, threshold: float = 0.7, least: int = 12, part: int = PART) -> DataFrame:
    """(space, id, class_id, links): the group that each text with enough words is in, named by its
    smallest id, and the number of other texts (not counting copies) that it is paired with."""
    members, pairs = alike_sets(texts, threshold, least, part)
    sets = publish(members.groupBy("node").agg(F.min("rep").alias("least_id"), F.count_distinct("copy").alias("texts")), "node-sizes")
    a = sets.select(F.col("node").alias("a"), F.col("least_id").alias("x"), F.col("texts").alias("ta"))
    b = sets.select(F.col("node").alias("b"), F.col("least_id").alias("y"), F.col("texts").alias("tb"))
    full = publish(pairs.join(a, "a").join(b, "b"), "full")
    degree = full.select(F.col("a").alias("node"), F.col("tb").alias("t")).unionByName(full.select(F.col("b").alias("node"), F.col("ta").alias("t")))
    degree = degree.groupBy("node").agg(F.sum("t").alias("t"))
    # a component's nodes are of one space; it is named by the node with its smallest id
    comp = publish(connected_components(full.select(F.struct("x", "a").alias("p"), F.struct(F.col("y").alias("x"), F.col("b").alias("a")).alias("q")), "p", "q"), "classes")
    named = sets.join(comp.select(F.col("node.a").alias("node"), F.col("component.x").alias("class_id")), "node", "left").join(degree, "node", "left")
    named = named.select("node", F.coalesce("class_id", "least_id").alias("class_id"), (F.coalesce("t", F.lit(0)) + F.col("texts") - 1).alias("links"))
    return members.select("space", "id", "node").join(named, "node").select("space", "id", "class_id", "links")


def copies(texts: DataFrame, least: int = 12) -> DataFrame:
    """(space, id, rep, copies): each text with enough words that isn't alone, the smallest id with the
    same text, and how many there are."""
    first = _given(texts).mapInArrow(_first_pass(least), FIRST)
    return _members(publish(first, "sets")).where("copies > 1").select("space", "id", "rep", "copies")


def radius(n: int, m: int, threshold: float) -> int:
    """The most words by which sets of n and m words that are alike can differ."""
    return math.floor((n + m) * (1 - threshold) / (1 + threshold) + 1e-9)
