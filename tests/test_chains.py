"""Chains over trees, entries and scraped lists against brute force."""

import random
from collections import defaultdict

from lexoria.operators import senses as T, synonyms as Y

MARKS = str.maketrans("țșăâî", "tsaai")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_expand_trees(spark):
    te = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (2, 9, 0), (3, 5, 0)], "tree_id long, entry_id long, entry_rank int")
    el = spark.createDataFrame([(7, "b", 1, 1), (7, "a", 2, 1), (8, "a", 5, 1), (8, "c", 1, 0), (9, None, 1, 1), (9, "d", 2, 1)], "entry_id long, word string, lexeme_rank int, main int")
    assert rows(Y.expand_trees(te, el)) == [(1, "a", 0), (1, "b", 1), (2, "d", 0)]


def test_tree_synonyms(spark):
    m = spark.createDataFrame([(1, 10, 0), (2, 10, 2), (3, 11, 0), (4, 12, 0)], "meaning_id long, tree_id long, type int")
    t = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "tree_id long, word string")
    rel = spark.createDataFrame([(5, 1, 12, 1), (4, 1, 11, 1), (6, 1, 99, 1), (7, 1, 11, 2), (8, 2, 11, 1), (9, 4, 10, 1)], "id long, meaning_id long, target_tree long, type int")
    got = rows(Y.tree_synonyms(m, t, spark.createDataFrame([("a",), ("b",)], "word string"), rel))
    assert got == [(1, "a", 10, 0, "b|c"), (2, "a", 10, 2, None), (3, "b", 11, 0, None)]


def walked(meanings):
    """`entry_text` by recursion."""
    key, ids, seen, units = lambda m: (m[3], m[0]), {m[0] for m in meanings}, set(), []
    kids = lambda i, types: sorted((m for m in meanings if m[1] == i and m[2] in types), key=key)

    def emit(m):
        if m[0] not in seen:
            seen.add(m[0])
            units.append([m, *kids(m[0], (1, 2))])
            for c in kids(m[0], (0, 4, 5)):
                emit(c)

    for inside in (False, True):
        for m in sorted(meanings, key=key):
            if m[2] in (0, 4, 5) and (inside or m[1] not in ids):
                emit(m)
    out = []
    for m, *hung in units:
        if m[2] == 0 and m[5] and " " not in m[5]:
            continue
        body = ((m[4] + " " if m[4] else "") + m[5]).strip()
        body += "".join((" – " if c[2] == 1 else " ◊ ") + c[5] for c in hung if c[5])
        if body:
            out.append(body)
    return " | ".join(out)


def test_entry_text():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 9)
        m = [(i, r.choice([0, r.randint(1, n + 1)]), r.choice([0, 0, 0, 1, 2, 3, 4, 5]), r.randint(0, 2), r.choice(["", "1."]), r.choice(["", "unu", "a b", "c d e"])) for i in range(1, n + 1)]
        assert T.entry_text(m) == walked(m)
    deep = [(i, i - 1, 0, 0, "", "a b") for i in range(1, 5001)]
    assert T.entry_text(deep).count(" | ") == 4999


def test_definitions_from_trees(spark):
    d = spark.createDataFrame([(i, f"w{i}") for i in range(1, 6)], "def_id long, word string")
    ed = spark.createDataFrame([(2, 20), (3, 30), (4, 40), (5, 50), (5, 51)], "def_id long, entry_id long")
    te = spark.createDataFrame([(30, 300), (40, 400), (50, 500), (51, 501), (51, 500)], "entry_id long, tree_id long")
    m = [(1, 400, 0, 0, 1, "", "$Abonament[476691]-legitimație[476691]$."), (2, 500, 0, 0, 2, "1.", "al doilea"), (3, 501, None, 0, 1, None, "@primul sens@"), (4, 501, 3, 1, 1, "", "din latină")]
    m = spark.createDataFrame(m, "meaning_id long, tree_id long, parent_id long, type int, display_order int, breadcrumb string, text string")
    got = {r.def_id: (r.status, r.definition) for r in T.definitions_from_trees(d, ed, te, m).collect()}
    assert got == {1: ("no_entry", None), 2: ("no_tree", None), 3: ("no_meanings", None), 4: ("no_text", None), 5: ("ok", "primul sens – din latină | 1. al doilea")}


def merged(words, keys, senses, edges, scraped, base):
    """`merge_scrape` row by row."""
    ids, top, index, of, edge = dict(words), max([0, *(i for _, i in words)]), defaultdict(set), defaultdict(set), {tuple(e[:3]): e[3] for e in edges}
    name, new_words, new_senses = {i: w for w, i in words}, [], []

    def key(k, i):
        index[k].add(i)
        index[k.translate(MARKS)].add(i)

    def resolve(f):
        nonlocal top
        if f in ids:
            i = ids[f]
        elif index[f]:
            i = min(index[f])
        else:
            i = top = top + 1
            ids[f], name[i] = i, f
            new_words.append((f, i))
        key(f, i)
        return i

    for w, i in words:
        key(w, i)
    for k, w in keys:
        key(k, ids[w])
    for s, w in senses:
        of[ids[w]].add(s)
    for _, head, *lists in sorted(scraped):
        head = (head or "").lower()
        if not head:
            continue
        i = resolve(head)
        if not of[i]:
            of[i].add(base + len(new_senses))
            new_senses.append((base + len(new_senses), name[i]))
        for kind, text in enumerate(lists, 1):
            for t in filter(None, map(str.strip, (text or "").split(","))):
                if "=" not in t and not t.isupper():
                    edge.setdefault((min(of[i]), name[resolve(t.lower())], kind), 1)
    return sorted(new_words), sorted(new_senses), sorted((*k, v) for k, v in edge.items())


def test_merge_scrape(spark):
    r = random.Random(11)
    form = lambda: "".join(r.choice("aăsș") for _ in range(r.randint(1, 3)))
    for _ in range(6):
        words = [(w, 10 + i) for i, w in enumerate(sorted({form() for _ in range(6)}))]
        some = [w for w, _ in words]
        keys = [(form(), r.choice(some)) for _ in range(5)]
        keys = sorted({x for k, w in keys for x in ((k, w), (k.translate(MARKS), w))})
        senses = [(100 + i, r.choice(some[::2])) for i in range(5)]
        edges = sorted({(s, r.choice(some), 1): 2 for s, _ in senses}.items())
        edges = [(*k, v) for k, v in edges]
        texts = lambda: r.choice([None, ", ".join(r.choice([form(), form(), "AA", "x=y", "", form().capitalize()]) for _ in range(4))])
        scraped = [(p, r.choice([form(), form(), None, ""]), texts(), texts()) for p in r.sample(range(99), 25)]
        want = merged(words, keys, senses, edges, scraped, 1000)
        # single capitals are dirty tokens in both
        got = Y.merge_scrape(
            spark.createDataFrame(words, "word string, word_id long"), spark.createDataFrame(keys, "key string, word string"), spark.createDataFrame(senses, "sid long, word string"),
            spark.createDataFrame(edges, "sid long, word string, type int, src int"), spark.createDataFrame(scraped, "pos long, word string, synonyms string, antonyms string"), 1000,
        )
        assert tuple(rows(x) for x in got) == want


def test_linked_words_of_a_tree_are_left_out(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "d")], "tree_id long, word string")
    te = spark.createDataFrame([(1, 7), (1, 8), (2, 9)], "tree_id long, entry_id long")
    pairs = Y.tree_pairs(m, te, spark.createDataFrame([("b", "a"), ("a", "c")], "a string, b string"))
    assert rows(pairs) == [(1, "b", "c")]
    assert rows(Y.tree_cliques(pairs, spark.createDataFrame([("b",)], "word string"), 100)) == [(101, "b", 5, 2, 0), (101, "c", 5, 2, 1)]
