"""A graph of words through senses: sense_word(sid, word), edge(sid, word, type, src)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexoria.functions import text as X
from lexoria.operators.rank import global_rank
from lexoria.plans.runtime import publish


def aliases(main: DataFrame, variants: DataFrame) -> DataFrame:
    """(key, word): keys under which a word is found: itself and its variants, as they are and folded."""
    rows = main.select(F.col("word").alias("k"), "word").unionByName(variants.select(F.col("variant").alias("k"), "word"))
    return rows.select(F.explode(F.array(F.col("k"), X.fold("k"))).alias("key"), "word").where("key is not null").distinct()


def relation_edges(relations: DataFrame, tree_words: DataFrame) -> DataFrame:
    """(sid, word, type): words of a relation's target tree; relations with an empty end give nothing.
    `relations`: sid, source_tree, target_tree, type; `tree_words`: tree_id, word."""
    source = tree_words.select(F.col("tree_id").alias("source_tree")).distinct()
    target = tree_words.select(F.col("tree_id").alias("target_tree"), "word")
    return relations.join(source, "source_tree", "left_semi").join(target, "target_tree").select("sid", "word", "type").distinct()


def expand_trees(tree_entries: DataFrame, entry_lexemes: DataFrame) -> DataFrame:
    """(tree_id, word, position): main lexemes of a tree's entries in the order of the ranks, each word at
    its first place, from 0. `tree_entries`: tree_id, entry_id, entry_rank; `entry_lexemes`: entry_id, word,
    lexeme_rank, main."""
    rows = tree_entries.join(entry_lexemes.where("main = 1 and word <> ''"), "entry_id")
    first = rows.groupBy("tree_id", "word").agg(F.min(F.struct("entry_rank", "entry_id", "lexeme_rank")).alias("at"))
    return global_rank(first, ["at", "word"], "position", ["tree_id"]).select("tree_id", "word", (F.col("position") - 1).alias("position"))


def tree_synonyms(meanings: DataFrame, trees: DataFrame, shortlist: DataFrame, relations: DataFrame) -> DataFrame:
    """(meaning_id, word, tree_id, type, synonyms): meanings of the trees of listed words; of senses also the
    words of the trees that relations of type 1 lead to, in the relations' order, joined by '|', null if
    there are none. Relations to trees that there aren't are dropped. `meanings`: meaning_id, tree_id, type;
    `trees`: tree_id, word; `shortlist`: word; `relations`: id, meaning_id, target_tree, type."""
    kept = meanings.select("meaning_id", "tree_id", "type").join(trees.join(shortlist, "word", "left_semi"), "tree_id")
    rel = relations.where("type = 1").select("id", "meaning_id", F.col("target_tree").alias("tree_id"))
    rel = rel.join(kept.where("type = 0").select("meaning_id"), "meaning_id", "left_semi")
    hit = rel.join(trees.where("word <> ''").withColumnRenamed("word", "synonym"), "tree_id").groupBy("meaning_id")
    hit = hit.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "synonym"))), lambda x: x["synonym"]), "|").alias("synonyms"))
    return kept.join(hit, "meaning_id", "left").select("meaning_id", "word", "tree_id", "type", "synonyms")


def merge_scrape(words: DataFrame, keys: DataFrame, sense_word: DataFrame, edges: DataFrame, scraped: DataFrame, base: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New words (word, word_id), new senses (sid, word) and all edges (sid, word, type, src) after lists of
    synonyms (type 1) and antonyms (type 2) were read row by row.

    A form is a word of that form, else the first word that has it as a key, else a new word with keys of
    its own. A row's list hangs on its word's lowest sense, or on a new one from `base`; edges that are
    there keep their source, new ones have 1. `words`: word, word_id; `keys`: key, word; `sense_word`: sid,
    word; `scraped`: pos, word, synonyms, antonyms.

    Only new forms depend on the order of rows: one without marks is the first new word that folds to it,
    if that came before. All others are resolved by joins.
    """
    strip = lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    rows = scraped.withColumn("word", X.normalize("word")).where("word <> ''")
    parts = []
    for kind, c in ((1, "synonyms"), (2, "antonyms")):
        t = rows.select("pos", F.posexplode(F.split(c, ",")).alias("i", "t")).withColumn("t", strip(F.col("t")))
        parts.append(t.where((F.col("t") != "") & ~X.is_dirty_token("t")).select("pos", F.lit(kind).alias("kind"), "i", X.normalize("t").alias("form")))
    heads = rows.select("pos", F.lit(0).alias("kind"), F.lit(0).alias("i"), F.col("word").alias("form"))
    terms = publish(heads.unionByName(parts[0]).unionByName(parts[1]), "terms")

    first = terms.groupBy("form").agg(F.min(F.struct("pos", "kind", "i")).alias("at"))
    every = keys.select("key", "word").unionByName(aliases(words, words.select("word", F.col("word").alias("variant"))))
    keyed = every.join(words, "word").groupBy(F.col("key").alias("form")).agg(F.min_by("word", "word_id").alias("by_key"))
    got = first.join(words.select(F.col("word").alias("form"), F.lit(True).alias("own")), "form", "left").join(keyed, "form", "left")
    got = publish(got.withColumn("known", F.when(F.col("own"), F.col("form")).otherwise(F.col("by_key"))).select("form", "at", "known"), "forms")
    marked = got.where("known is null").select(X.fold("form").alias("plain"), "form", "at").where("plain <> form")
    marked = marked.groupBy(F.col("plain").alias("form")).agg(F.min(F.struct("at", "form")).alias("m"))
    before = F.col("m.at") < F.col("at")
    word = F.coalesce("known", F.when(before, F.col("m.form")), "form")
    got = publish(got.join(marked, "form", "left").select("form", "at", "known", word.alias("word")), "resolved")

    top = words.agg(F.coalesce(F.max("word_id"), F.lit(0)).alias("t")).first()["t"]
    fresh = got.where("known is null and word = form").select("word", "at.pos", "at.kind", "at.i")
    new_words = global_rank(fresh, ["pos", "kind", "i"], "k").select("word", (F.lit(top) + F.col("k")).cast("long").alias("word_id"))

    named = terms.join(got.select("form", "word"), "form").select("pos", "kind", "word")
    old = sense_word.groupBy("word").agg(F.min("sid").alias("old"))
    own = publish(named.where("kind = 0").select("pos", "word").join(old, "word", "left"), "heads")
    new_senses = global_rank(own.where("old is null").groupBy("word").agg(F.min("pos").alias("pos")), ["pos"], "k").select((F.lit(base - 1) + F.col("k")).cast("long").alias("sid"), "word")
    new_senses = publish(new_senses, "senses")
    at = own.join(new_senses, "word", "left").select("pos", F.coalesce("old", "sid").cast("long").alias("sid"))
    added = named.where("kind > 0").join(at, "pos").select("sid", "word", F.col("kind").alias("type")).distinct()
    added = added.join(edges, ["sid", "word", "type"], "left_anti").select("sid", "word", "type", F.lit(1).alias("src"))
    return new_words, new_senses, edges.select("sid", "word", "type", "src").unionByName(added)


def merge_sources(edges: DataFrame) -> DataFrame:
    """(sid, word, type, src): each edge once, of the source that comes first."""
    return edges.groupBy("sid", "word", "type").agg(F.min("src").alias("src"))


def cliques(groups: DataFrame, edges: DataFrame, base: int, src: int = 2) -> tuple[DataFrame, DataFrame]:
    """Senses of groups whose members are all alike: (sid, word) and edges, one per member rather than per
    pair; members that an edge of type 1 links to the group already are left out. `groups`: group_id, word."""
    g = groups.select((F.lit(base) + F.col("group_id")).alias("sid"), "word").distinct()
    sizes = g.groupBy("sid").agg(F.count("*").alias("n")).where("n > 1")
    g = g.join(sizes, "sid", "left_semi").join(edges.where("type = 1").select((F.lit(base) + F.col("sid")).alias("sid"), "word"), ["sid", "word"], "left_anti")
    return g, g.select("sid", "word", F.lit(1).alias("type"), F.lit(src).alias("src"))


def ordered_senses(claimed: DataFrame, bands: DataFrame) -> DataFrame:
    """(word, sid, member, sense_place, member_place): a word's senses by their members' highest band and
    then by number, members of a sense by band and then by name, from 1. `claimed`: word, sid, member, each
    member in one sense of a word; `bands`: word, band, 0 for others."""
    m = claimed.join(bands.select(F.col("word").alias("member"), "band"), "member", "left").select("word", "sid", "member", (-F.coalesce("band", F.lit(0))).alias("_b"))
    m = publish(m, "claimed")
    senses = m.groupBy("word", "sid").agg(F.min("_b").alias("_b"))
    senses = global_rank(senses, ["_b", "sid"], "sense_place", ["word"]).select("word", "sid", "sense_place")
    return global_rank(m, ["_b", "member"], "member_place", ["word", "sid"]).join(senses, ["word", "sid"]).select("word", "sid", "member", "sense_place", "member_place")


def tree_pairs(members: DataFrame, tree_entries: DataFrame, linked: DataFrame) -> DataFrame:
    """(tree_id, a, b), a < b: words of one tree of several entries that no edge of type 1 links, in either
    direction. `members`: tree_id, word; `tree_entries`: tree_id, entry_id; `linked`: a, b."""
    several = tree_entries.groupBy("tree_id").agg(F.count_distinct("entry_id").alias("n")).where("n > 1")
    m = members.join(several, "tree_id", "left_semi").select("tree_id", "word").distinct()
    pairs = m.withColumnRenamed("word", "a").join(m.withColumnRenamed("word", "b"), "tree_id").where("a < b")
    seen = linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(seen, ["a", "b"], "left_anti").select("tree_id", "a", "b")


def tree_cliques(pairs: DataFrame, has_edge: DataFrame, base: int, src: int = 2) -> DataFrame:
    """(sid, word, type, src, gains): edges of type 5 of the words of `tree_pairs`; `gains` is 1 for a word
    that had no edge (`has_edge`: word), so that its sum is the number of words that gain a first one."""
    w = pairs.select((F.lit(base) + F.col("tree_id")).alias("sid"), F.explode(F.array("a", "b")).alias("word")).distinct()
    had = has_edge.select("word").distinct().withColumn("had", F.lit(1))
    return w.join(had, "word", "left").select("sid", "word", F.lit(5).alias("type"), F.lit(src).alias("src"), (1 - F.coalesce("had", F.lit(0))).alias("gains"))


def neighbours(sense_word: DataFrame, edge: DataFrame, kind: int = 1, words: DataFrame | None = None) -> DataFrame:
    """(word, sid, member): both ways through senses, the word itself left out. With `words` (word) only
    theirs."""
    e = edge.where(F.col("type") == kind).select("sid", F.col("word").alias("member"))
    pairs = sense_word.select("sid", "word").join(e, "sid")
    out = pairs.select("word", "sid", "member").unionByName(pairs.select(F.col("member").alias("word"), "sid", F.col("word").alias("member")))
    if words is not None:
        out = out.join(words.select("word").distinct(), "word", "left_semi")
    return out.where("word <> member").distinct()


def edge_ranks(edge: DataFrame, bands: DataFrame) -> DataFrame:
    """(sid, type, word, nth): members of a sense by falling band, then by name, from 0."""
    rows = edge.join(bands, "word", "left").select("sid", "type", "word", (-F.coalesce("band", F.lit(0))).alias("_b"))
    return global_rank(rows, ["_b", "word"], "nth", ["sid", "type"]).select("sid", "type", "word", (F.col("nth") - 1).alias("nth"))


def claim(near: DataFrame, bands: DataFrame) -> DataFrame:
    """(word, sid, member): each neighbour of a word in one sense only: that with the most members, then
    the highest band, then the lowest sid. Sizes are those before any claim."""
    rows = near.join(bands.select(F.col("word").alias("member"), "band"), "member", "left").withColumn("band", F.coalesce("band", F.lit(0)))
    rich = rows.groupBy("word", "sid").agg(F.count("*").alias("size"), F.max("band").alias("top"))
    best = F.min(F.struct(-F.col("size"), -F.col("top"), F.col("sid"))).alias("r")
    return rows.join(rich, ["word", "sid"]).groupBy("word", "member").agg(best).select("word", F.col("r.sid").alias("sid"), "member")


def neighbourhood(sense_word: DataFrame, edge: DataFrame, bands: DataFrame, centre: str, caps=(4, 6, 12, 4, 24)) -> list[tuple[int, str, str]]:
    """Two rings around a word as (ring, parent, word), capped: senses, members per sense, first ring,
    members per parent, second ring; no word comes twice. The caps are what the report is."""
    senses, per_sense, ring1, per_parent, ring2 = caps
    spark = edge.sparkSession

    def ranked(words: list[str]) -> DataFrame:
        w = spark.createDataFrame([(x,) for x in words], "word string")
        c = claim(neighbours(sense_word, edge, 1, w), bands).join(bands.select(F.col("word").alias("member"), "band"), "member", "left")
        return c.withColumn("band", F.coalesce("band", F.lit(0)))

    first = ranked([centre]).withColumn("nth", F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("band"), "member")))
    size = first.groupBy("sid").agg(F.count("*").alias("n"), F.max("band").alias("top")).orderBy(F.desc("n"), F.desc("top"), "sid").limit(senses)
    order = {r["sid"]: i for i, r in enumerate(size.collect())}
    rows = first.where(F.col("sid").isin(list(order)) & (F.col("nth") <= per_sense)).collect() if order else []
    rows = sorted(rows, key=lambda r: (order[r["sid"]], r["nth"]))[:ring1]
    out, used = [(1, centre, r["member"]) for r in rows], {centre, *(r["member"] for r in rows)}
    if rows:
        near = ranked([r["member"] for r in rows]).where(~F.col("member").isin(list(used)))
        w = Window.partitionBy("word").orderBy(F.desc("band"), "member")
        near = near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_parent + ring2)
        by: dict[str, list] = {}
        for r in sorted(near.collect(), key=lambda r: r["nth"]):
            by.setdefault(r["word"], []).append(r["member"])
        for r in rows:
            got = 0
            for m in by.get(r["member"], ()):
                if got == per_parent or len(out) == len(rows) + ring2:
                    break
                if m not in used:
                    used.add(m)
                    out.append((2, r["member"], m))
                    got += 1
    return out
