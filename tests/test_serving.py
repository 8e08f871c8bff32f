import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexoria.functions import text as X
from lexoria.operators import community as M, explore as E, flags as G, sampling as S, senses as T, synonyms as Y
from lexoria.operators.hierarchy import hierarchy
from lexoria.streaming import jobs


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first().x


def test_text_functions(spark):
    go = lambda c, **v: one(spark, c, **v)
    assert go(X.normalize("t"), t="ŞEDINŢĂ Ă") == "ședință ă" and go(X.normalize("t"), t=None) is None
    assert go(X.fold("t"), t="Șțâîă é") == "staia é"
    assert go(X.tokenize("t"), t="a ab abc bine-cunoscut -x- d'ale 12") == ["abc", "bine-cunoscut", "d'ale"]
    assert go(X.latest_year("t"), t="1955-1957, f.a. 3000") == 1957 and go(X.latest_year("t"), t="f.a.") is None
    assert go(X.clean_markup("t"), t="12@a$ {{x}}  b#") == "a b" and go(X.clean_markup("t"), t=" @ ") is None
    assert go(X.clean_entry("t"), t="$Abonament[476691]-legitimație[476691]$.") == "Abonament-legitimație."
    assert go(X.pointer_target("t"), t=" vezi Tinereţe. ") == "tinerețe" and go(X.pointer_target("t"), t="vezi a b") is None
    assert go(X.crumb_key("t"), t=" 10. 2 ") == [10, 2] and go(X.crumb_key("t"), t=None) == []
    assert go(X.split_clean("t"), t=" a | | b|") == ["a", "b"]
    assert go(X.excerpt("t", 10), t="unu doi trei patru|x") == "unu doi…"
    assert go(X.mask_word("t", "w"), t="Casa casă CASA c.sa", w="casa") == "——— casă ——— c.sa"
    assert go(X.mask_word("t", "w"), t="a.b", w="") == "a.b"
    assert go(X.slug("t"), t=" Cuvântul meu! ") == "cuvantul-meu"
    assert [go(X.count_phrase("n", "cuvânt", "cuvinte"), n=n) for n in (0, 1, 19, 20, 101, 120)] == ["0 cuvinte", "1 cuvânt", "19 cuvinte", "20 de cuvinte", "101 cuvinte", "120 de cuvinte"]
    assert go(X.entry_words("t", "h"), t="FRUMOS adj. 1. mândru, chipeș (fig.), v. arătos și altele. 2. Frumos, mândru; a", h="frumos") == ["mândru", "chipeș"]
    assert go(X.strip_stress("t"), t="cásă cásă ță") == "casă casă ță"
    assert go(X.is_dirty_token("t"), t="a=b") and go(X.is_dirty_token("t"), t="ABc") and not go(X.is_dirty_token("t"), t="abC")
    assert go(X.reveals_word("t", "w"), t="formă a cuvintelor", w="cuvinte") and not go(X.reveals_word("t", "w"), t="altceva", w="cuvinte")
    assert go(X.clean_tags("t"), t=[" a ", "", "a", "b" * 50]) == ["a", "b" * 40]
    assert go(X.page_url("http://x/", "t"), t="a b&ș") == "http://x/a%20b%26%C8%99"
    assert go(X.human_duration("n"), n=3725) == "1h 02m" and go(X.human_count("n"), n=1500) == "1.5k"
    assert go(F.levenshtein(F.col("a"), F.col("b")), a="lăcrăma", b="lăcrima") == 1


WORDS = [("Casă", 5, "A|B", None, 1, 0), ("masă", 50, "B", 2001, 0, 0), ("șură", 500, None, 2010, None, 1), ("abac", 0, "", 1990, 0, 0)]


def table(spark):
    return spark.createDataFrame(WORDS, "word string, occ long, src string, year int, dim int, dev int").withColumn("folded", X.fold("word"))


SHEET = E.Sheet(
    choices={"w": ("word", ["Casă", "masă", "șură", "abac"])}, tags={"s": ("src", ["A", "B", "C"])}, at_least={"min": "occ"}, below={"before": "year"},
    from_={"after": "year"}, present={"y": "year"}, scaled={"o": ("occ", 10)}, classes={"dim": (["dim"], "hide"), "all": (["dim", "dev"], "show")},
)


@pytest.mark.parametrize(
    "params, want",
    [({}, {"masă", "șură", "abac"}), ({"dim": "show"}, {"Casă", "masă", "șură", "abac"}), ({"dim": "only"}, {"Casă"}), ({"dim": "show", "all": "only"}, {"Casă", "șură"}),
     ({"w": "masă,abac, x"}, {"masă", "abac"}), ({"w": "Casă,masă,șură,abac"}, {"masă", "șură", "abac"}), ({"s": ["B"], "dim": "show"}, {"Casă", "masă"}), ({"min": "50"}, {"masă", "șură"}),
     ({"min": "x"}, {"masă", "șură", "abac"}), ({"before": 2001, "dim": "show"}, {"abac"}), ({"after": 2001, "dim": "show"}, {"masă", "șură"}), ({"y": 0, "dim": "show"}, {"Casă"}),
     ({"o": "1-10"}, {"masă"}), ({"o": "-1"}, {"abac"}), ({"dim": "nonsense"}, {"masă", "șură", "abac"})],
)
def test_filters(spark, params, want):
    assert {r.word for r in table(spark).where(E.build_filter(SHEET, params)).collect()} == want


def test_scopes_marks_and_pages(spark):
    w = table(spark)
    words = lambda df: [r.word for r in df.collect()]
    got, mode = E.scope(w, SHEET, {"q": "CAS", "min": 999})
    assert mode == "search" and words(got) == ["Casă"]
    assert words(E.scope(w, SHEET, {"q": "sura"})[0]) == ["șură"]
    assert E.scope(w, SHEET, {}, w.limit(0).select("word"))[0].count() == 0
    marks = spark.createDataFrame([(1, "masă", 0, "x", None, 0), (1, "abac", 1, None, ["t"], 0), (1, "șură", 1, "", [], 1), (2, "Casă", 1, "", ["t"], 0)], "user_id long, word string, bookmarked int, note string, tags array<string>, deleted int")
    kinds = {k: set(words(E.by_marks(w, marks, k, 1))) for k in ("bookmarked", "noted", "marked", "unmarked", "tag:t", "other")}
    assert kinds == {"bookmarked": {"abac"}, "noted": {"masă"}, "marked": {"masă", "abac"}, "unmarked": {"Casă", "șură"}, "tag:t": {"abac"}, "other": {x[0] for x in WORDS}}
    keys = E.ordered(w, [F.desc("occ")], demote="m", pin="abac")
    assert words(E.page(w, keys, 1, 3)) == ["abac", "șură", "Casă"] and words(E.page(w, keys, 2, 3)) == ["masă"]
    pts = spark.createDataFrame([(n,) for n in (0, 1, 2, 4, 8, 16, 32, 64, 65, -3)], "n int").select(E.vote_points(F.col("n")).alias("p"))
    assert [r.p for r in pts.collect()] == [0, 3, 4, 6, 8, 10, 12, 15, 18, -6]
    nodes = spark.createDataFrame([("casă", 3, "casa"), ("casat", 2, "casat"), ("ocazie", 1, "ocazie")], "word string, band int, key string")
    assert words(E.resolve(nodes, "Casă")) == ["casă"] and words(E.resolve(nodes, "cas")) == ["casă", "casat"] and words(E.resolve(nodes, "azi")) == ["ocazie"]
    assert E.resolve(nodes, "zzz").count() == 0


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(50)], "k int, g string")
    a = S.stratified(df, "g", "k", 3, 5)
    assert {r.g: r["count"] for r in a.groupBy("g").count().collect()} == {"a": 3, "b": 3}
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in S.stratified(df.repartition(7), "g", "k", 3, 5).collect()}
    assert S.stratified(df, "g", "k", 3, 9, taken=a.where("g = 'a'").select("k", "g")).where("g = 'a'").exceptAll(a.where("g = 'a'")).count() == 0
    assert S.sample(df, "k", 1000).count() == 50 and S.of_the_day(df, "k", 52).first().k == 2 and S.of_the_day(df.limit(0), "k", 2).count() == 0


def test_community(spark):
    rows = [(1, "w", 1, ["meh"], 0), (2, "w", 0, ["meh"], 0), (3, "w", 0, ["lol"], 1), (4, "w", 0, None, 0), (5, "v", None, ["lol", "meh"], 0)]
    s = spark.createDataFrame(rows, "user_id long, word string, bookmarked int, tags array<string>, deleted int")
    assert {r.word: r.votes for r in M.votes(s).collect()} == {"w": 0, "v": 1}
    assert {r.word: (r.n_fav, r.n_lol, r.n_up, r.n_down) for r in M.mark_counts(s).collect()} == {"w": (1, 0, 1, 2), "v": (0, 1, 1, 1)}
    a = spark.createDataFrame([(1, "m", i, k) for i, k in enumerate([1, 1, 0, 1, 1, 1])] + [(2, "m", 0, 0)], "u long, m string, t int, ok int")
    st = {(r.user, r.mode): (r.answers, r.correct, r.best, r.current) for r in M.streaks(a, "u", "m", ["t"], "ok").collect()}
    assert st == {(1, "m"): (6, 5, 3, 3), (1, "all"): (6, 5, 3, 3), (2, "m"): (1, 0, 0, 0), (2, "all"): (1, 0, 0, 0)}
    items = spark.createDataFrame([("l", "a", 0), ("l", "b", 1)], "list string, word string, position int")
    want = spark.createDataFrame([("l", "b"), ("l", "d"), ("l", "c"), ("k", "x")], "list string, word string")
    assert {tuple(r) for r in M.refresh_list(items, want).collect()} == {("l", "b", 1), ("l", "c", 2), ("l", "d", 3), ("k", "x", 0)}


BRAVE = (
    "CURAJOS adj., adv. 1. adj. brav, cutezător, dârz, (livr.) intrepid, temerar, (rar) bărbat, (înv. și pop.) voinic, (înv.) hrăbor. (Om ~.) "
    "2. adj. bărbătesc, brav, (reg.) bărbătos. (Atitudine, faptă ~oasă.)"
)


def test_words_of_an_entry(spark):
    rows = [
        (BRAVE, "curajos", ["brav", "cutezător", "dârz", "intrepid", "temerar", "bărbat", "voinic", "hrăbor", "bărbătesc", "bărbătos"]),
        ("CASĂ sf. locuință, cămin.", "casă", ["locuință", "cămin"]), ("MERGE vt. vi. a umbla, vi. a se duce", "merge", ["a umbla", "a se duce"]),
        ("ROZĂ s. trandafir, rug, rujă. ROZ adj. trandafiriu", "roză", ["trandafir", "rug", "rujă", "trandafiriu"]), ("ROZĂ s. v. rozetă.", "roză", []),
        ("ROZĂ s. v. rozetă cea mare, rug", "roză", ["rug"]), ("NĂDUȘI vb. a   înnăduși, gâtui", "năduși", ["a înnăduși", "gâtui"]),
        ("X s. a-și da duhul, o expresie mult prea lungă ca să fie un sinonim real aici", "x", ["a-și da duhul"]),
        ("CELE ZECE PORUNCI     decalogul", "x", ["decalogul"]), ("Curajos ≠ fricos, laș", "curajos", ["Curajos ≠ fricos", "laș"]), ("≠ rău; * bun -; ~", "x", ["rău", "bun"]),
        ("ABC, a, DE", "x", []), ("Bun, bun, BUN, búnă", "x", ["Bun", "bună"]), (None, "x", None), ("", "x", []), ("b. c", None, []),
    ]
    df = spark.createDataFrame(rows, "t string, h string, want array<string>")
    for r in df.select("t", "want", X.entry_words("t", "h").alias("got")).collect():
        assert r.got == r.want, r.t


def test_diminutives_and_old_spellings(spark):
    words = [("căsuță", "x"), ("mir", "Diminutiv al lui m."), ("văr", "Altceva|(Ca termen de adresare) Diminutiv al lui x"), ("alintare", "Țața e diminutiv, adică alintare"), ("masă", None),
             ("uță", "y"), ("noruleț", ""), ("mescioară", ""), ("boierică", ""), ("livrea", ""), ("NORIȘOR", "")]
    w = spark.createDataFrame(words, "word string, definition string")
    f = spark.createDataFrame([("căsă",), ("nor",), ("Mesă",), ("boier",), ("livr",), ("boieră",)], "form string")
    got = {r.word: r.diminutive for r in G.diminutives(w, f).collect()}
    assert {k for k, v in got.items() if v} == {"căsuță", "mir", "văr", "noruleț", "mescioară", "NORIȘOR"} and len(got) == len(words)
    pairs = [("situațiune", "situație"), ("diviziune", "divizie"), ("pasiune", "pasie"), ("sburat", "zburat"), ("desghețat", "dezghețat"), ("advocat", "avocat")]
    counts = [(a, 2) for a, _ in pairs] + [(b, 40) for _, b in pairs] + [("albiu", 1), ("albi", 999), ("pavea", 1), ("pava", 999), ("sgomot", 3), ("zgomot", 59)]
    n = spark.createDataFrame(counts, "word string, n long")
    assert {tuple(r) for r in G.archaic_spellings(n.withColumnRenamed("n", "own"), n).collect()} == set(pairs)


def test_variants(spark):
    words = spark.createDataFrame(
        [("tinereță", "x", 0), ("antereu", "x", 0), ("lăcrăma", None, 0), ("momiță", "x", 0), ("volintir", "Vezi voluntar.", 0), ("bejănar", "vezi băjenar", 0),
         ("uiet", "vezi huiet", 0), ("condițiune", "x", 1), ("sine", "vezi sine", 0), ("titlu", "vezi semnal și altele", 0)],
        "word string, definition string, archaic int",
    )
    entries = spark.createDataFrame(
        [(1, "tinereţă", 0), (1, "tinerețe", 1), (2, "antereu", 0), (2, "anteriu", 1), (3, "lăcrăma", 0), (3, "lăcrima", 1), (3, "reclama", 1), (4, "momiță", 0), (4, "maimuță", 1),
         (5, "momiță", 1), (6, "volintir", 1), (7, "uiet", 0), (7, "vuiet", 1), (8, "condițiune", 0), (8, "condiție", 1), (9, None, 1), (10, "titlu", 1), (11, "titlu", 0), (11, "semnal", 1)],
        "entry_id int, form string, main int",
    )
    n = {"tinereță": 381, "tinerețe": 227064, "antereu": 167, "anteriu": 1031, "reclama": 99999, "voluntar": 1_380_000, "băjenar": 3, "bejănar": 1, "huiet": 0, "vuiet": 4000, "maimuță": 9**6, "semnal": 9**6}
    counts = spark.createDataFrame(list(n.items()), "word string, n long")
    paradigms = spark.createDataFrame([("lăcrima", 16393)], "lemma string, n long")
    got = {r.variant: r["head"] for r in G.variants(words, entries, counts, paradigms).collect()}
    assert got == {"tinereță": "tinerețe", "lăcrăma": "lăcrima", "volintir": "voluntar", "uiet": "vuiet"}


def test_deverbal(spark):
    shapes = {"Faptul de a (se) zăhăi.": "zăhăi", "Acțiunea de a scăpăra și rezultatul ei.": "scăpăra", "Acțiunea de a se dărăpăna .": "dărăpăna", "Actiunea de a jelui": "jelui", "faptul de a (se) năduși": "năduși"}
    rows = [(f"n{i}", d, 0, "relevant") for i, d in enumerate(shapes)] + [(v, "A face.", 0, "relevant") for v in shapes.values()]
    rows += [("după", "Unealtă. | Faptul de a zăhăi.", 0, "relevant"), ("sine", "Faptul de a sine", 0, "relevant"), ("moleșire", "Faptul de a moleși", 0, "relevant"), ("moleși", "", 0, "curiosity"),
             ("jeluire", "Acțiunea de a (se) jelui.", 0, "curiosity"), ("ascundere", "Faptul de a ascunde", 0, "relevant"), ("ascunde", "", 1, "relevant"), ("fără", "Faptul de a pospăi.", 0, "relevant")]
    v = spark.createDataFrame(rows, "word string, definition string, dim int, seam string")
    got = {tuple(r) for r in G.deverbal(v, ["dim", "none"], seam="seam").collect()}
    assert got == {(f"n{i}", x) for i, x in enumerate(shapes.values())} | {("jeluire", "jelui")}
    assert ("moleșire", "moleși") in {tuple(r) for r in G.deverbal(v, ["dim"]).collect()}


def test_gates(spark):
    rows = [("Alamein", 0.5, "adj.", None, "proper_noun"), ("de facto", 0.5, "adv.", None, "foreign"), ("bine-cunoscut", 0.5, "adj.", None, "foreign"), ("ceva", 0.5, "", "T12", "no_description"),
            ("birjă", 0.5, "", "F12", "kept"), ("zapciu", 0.5, "ÎNV. cuvânt", None, "kept"), ("abc", 0.5, "adj.", "A", None), ("rara", 0.01, "adj.", "A", None), ("deasa", 1.0, "adj.", "A", None)]
    df = spark.createDataFrame(rows, "form string, frequency double, description string, kind string, want string")
    assert {(r.form, r.verdict) for r in G.curated(df).collect()} == {(r[0], r[4]) for r in rows if r[4]}
    q = [("a", "Care este foarte bun.", 3, 0, 1), ("b", "Care este foarte bun.", 2, 0, 0), ("c", "Vezi altceva mai jos", 3, 0, 0), ("d", "scurt|Care este foarte bun", 3, 0, 0), ("e", "Cuvânt lung aici:", 3, 0, 0),
         ("f", "SE spune despre ceva", 3, 0, 0), ("g", "Augmentativ al lui g", 5, 0, 0), ("h", "Care este foarte bun.", 5, 1, 0), ("i", None, 5, 0, 0)]
    df = spark.createDataFrame(q, "word string, definition string, dict_count int, flag int, want int")
    assert {r.word for r in df.where(G.fair_question(["flag"])).collect()} == {x[0] for x in q if x[4]}
    cls = spark.createDataFrame([("VT", "s.m.", "verb"), (" AF ", None, "adjectiv"), ("T", " Adv. ", "adverb"), ("I", "x", None), (None, None, None)], "k string, d string, want string")
    assert all(r.got == r.want for r in cls.select("want", G.word_class(F.col("k"), F.col("d")).alias("got")).collect())


def test_lists_and_copies(spark):
    items = spark.createDataFrame([("l", "a", 3), ("l", "b", 5), ("m", "z", 1)], "list string, word string, position int")
    want = spark.createDataFrame([("l", "c", 1), ("l", "b", 2), ("l", "d", 3), ("k", "x", 1), ("l", "e", 4)], "list string, word string, place int")
    assert {tuple(r) for r in M.fill_list(items, want, 3).collect()} == {("l", "b", 5), ("l", "c", 6), ("l", "d", 8), ("k", "x", 1)}
    local = spark.createDataFrame([("a", 5, "x"), ("b", 5, "x"), ("c", 5, "x"), ("d", 5, "x")], "word string, t int, note string")
    remote = spark.createDataFrame([("a", 5, "y", 0), ("b", 6, "y", 0), ("c", 6, "y", 1), ("e", 1, "y", 0), ("f", 1, "y", 1)], "word string, t int, note string, deleted int")
    assert {tuple(r) for r in M.apply_remote(local, remote, ["word"], "t", ["note"]).collect()} == {("a", 5, "x"), ("b", 6, "y"), ("d", 5, "x"), ("e", 1, "y")}


def test_sense_trees(spark):
    rows = [(1, 0, 0, "1.", 1, "unu"), (2, 1, 0, "1.10.", 2, "zece"), (3, 1, 0, "1.9.", 3, "nouă"), (4, 2, 2, "", 4, "citat"), (5, 4, 2, "", 5, "citat doi"), (6, 0, 4, "", 2, "compus"), (7, 99, 2, "", 1, "orfan"), (8, 3, 0, "1.9.1.", 1, " "), (9, 8, 2, "", 1, "sub gol")]
    df = spark.createDataFrame([(i, p, k, b, o, t, 7, "w") for i, p, k, b, o, t in rows], "meaning_id long, parent_id long, type int, breadcrumb string, display_order int, text string, tree_id long, word string")
    u = T.units(df)
    assert [(r.meaning_id, r.ord) for r in u.orderBy("ord").collect()] == [(1, 0), (3, 1), (2, 2), (6, 3)]
    tree = hierarchy(df.select(F.lit("m").alias("space"), F.col("meaning_id").alias("node"), F.col("parent_id").alias("parent"), F.col("tree_id").alias("scope")))
    a = T.attach(tree, u, df.where("type = 2"))
    assert {(r.meaning_id, r.unit_id) for r in a.collect()} == {(4, 2), (5, 2), (9, 3)}
    text = T.render(u, a.join(df.select("meaning_id", "text"), "meaning_id")).first().text
    assert text == "unu | nouă ◊ sub gol | zece ◊ citat ◊ citat doi | compus"


def test_synonyms(spark):
    se = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "sid long, word string")
    ed = spark.createDataFrame([(1, "b", 1, 0), (1, "c", 1, 0), (2, "c", 1, 0), (3, "d", 1, 0), (3, "d", 2, 0)], "sid long, word string, type int, src int")
    bd = spark.createDataFrame([("b", 3), ("c", 5)], "word string, band int")
    n = {(r.word, r.sid, r.member) for r in Y.neighbours(se, ed).collect()}
    assert n == {(m, s, w) for w, s, m in n} and ("a", 1, "b") in n and ("d", 3, "b") in n
    assert {(r.word, r.sid, r.member) for r in Y.claim(Y.neighbours(se, ed), bd).where("word = 'a'").collect()} == {("a", 1, "b"), ("a", 1, "c")}
    assert Y.neighbourhood(se, ed, bd, "a") == [(1, "a", "c"), (1, "a", "b"), (2, "b", "d")] and Y.neighbourhood(se, ed, bd, "zz") == []
    assert {tuple(r) for r in Y.merge_sources(ed.withColumn("src", F.lit(2)).unionByName(ed)).select("sid", "word", "type", "src").collect()} == {tuple(r) for r in ed.collect()}


def test_streams_equal_batches(spark, tmp_path):
    r = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), r.randrange(4), "m", r.random() * 20) for i in range(300)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    at = f"file://{tmp_path}"
    for k in range(3):
        ev.where(f"event_id between {k * 100} and {k * 100 + 99}").coalesce(1).write.parquet(f"{at}/events.parquet/p{k}")
    flat = f"{at}/flat"
    for k in range(3):
        spark.read.parquet(f"{at}/events.parquet/p{k}").coalesce(1).write.mode("append").parquet(f"{flat}/events.parquet")
    stream = lambda: jobs.source(spark, flat, "events", files_per_batch=1)
    a = stream().select("user_id", "ts", "event_id", (F.col("value") >= 10).cast("int").alias("ok"))
    got = {x.user_id: (x.answers, x.correct, x.best, x.current) for x in jobs.streak_stream(a).collect()}
    b = ev.select(F.col("user_id").alias("u"), F.lit("m").alias("m"), "ts", "event_id", (F.col("value") >= 10).cast("int").alias("ok"))
    want = {x.user: (x.answers, x.correct, x.best, x.current) for x in M.streaks(b, "u", "m", ["ts", "event_id"], "ok").where("mode = 'all'").collect()}
    assert got == want
    docs = stream().select("event_id", F.concat_ws(" ", F.lit("alfa beta"), F.col("event_type")).alias("text"))
    counts, home = jobs.count_stream(docs, F.col("event_id"))
    assert {x.word: (x.occurrences, x.documents) for x in counts.collect()} == {"alfa": (300, 300), "beta": (300, 300)}
    again, _ = jobs.count_stream(docs, F.col("event_id"), home)  # nothing new: nothing is added
    assert {x.word: x.occurrences for x in again.collect()} == {"alfa": 300, "beta": 300}
    assert jobs.first_uses(stream().select("user_id", "ts"), "user_id", "ts", "1 day").count() == len({x[2] for x in rows})
    assert sum(x.n for x in jobs.window_counts(stream(), "user_id", "ts", "1 hour").collect()) == 300
