"""Search, samples, communities, flags, trees, the synonym graph and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.functions import text as X
from lexoria.operators import community as M, corpus as C, explore as E, flags as G, sampling as S, senses as T, synonyms as Y
from lexoria.operators.changes import apply_changes
from lexoria.operators.hierarchy import hierarchy
from lexoria.operators.keyed import distinct_in_order, first_per_key, last_per_key
from lexoria.operators.rank import global_rank
from lexoria.plans.queries_lexicon import BASE, OBJ, _claims, _counts, _cover, _object_tags
from lexoria.plans.queries_problems import _EDGES, _nodes
from lexoria.plans.runtime import publish, read
from lexoria.sources import files
from lexoria.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, *also: str):
    def add(f):
        for n in (f.__name__, *also):
            QUERIES[n] = f
            if sql:
                ORACLES[n] = sql
        return f

    return add


# --- a serving table of words ------------------------------------------------------------------------

WORDS = """
with words as (
  select c.word, c.dict_count, c.sources, c.newest, f.definition, coalesce(o.n, 0) as occ, coalesce(o.docs, 0) as docs,
    case when coalesce(o.n, 0) = 0 then '0' when o.n < 20 then '1' else '2' end as tier,
    cast(coalesce(regexp_matches(lower(f.definition), '^diminutiv'), false) as int) as dim,
    cast(coalesce(regexp_matches(f.definition, '^(Faptul|Acțiunea) de a'), false) as int) as dev,
    translate(lower(c.word), 'țșţşăâî', 'tstsaai') as folded
  from (select word, count(distinct source_id) as dict_count, string_agg(distinct cast(source_id as varchar), '|' order by cast(source_id as varchar)) as sources,
          cast(max(year(to_timestamp(mod_date) at time zone 'UTC')) as int) as newest from definitions where word is not null group by word) c
  left join (select word, arg_min(definition, def_id) as definition from definitions where definition is not null and definition <> '' group by word) f using (word)
  left join (select word, cast(sum(coalesce(occurrence_count, 0)) as bigint) as n, cast(sum(coalesce(document_count, 0)) as bigint) as docs
             from (select distinct on (id) * from corpus_word_frequency where word is not null and corpus_name is not null) group by word) o using (word))
"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = _cover(spark, sf_dir).select("word", "dict_count", "sources", "newest")
    d = read(spark, sf_dir, "definitions").where("word is not null and definition <> ''").select("word", "definition", "def_id")
    first = first_per_key(d, ["word"], ["def_id"]).select("word", "definition")
    o = _counts(spark, sf_dir, False)
    zero = F.lit(0).cast("long")
    w = cover.join(first, "word", "left").join(o, "word", "left")
    occ = F.coalesce("occurrences", zero)
    return w.select(
        "word", "dict_count", "sources", "newest", "definition", occ.alias("occ"), F.coalesce("documents", zero).alias("docs"),
        F.when(occ == 0, "0").when(occ < 20, "1").otherwise("2").alias("tier"),
        F.coalesce(F.lower("definition").rlike("^diminutiv"), F.lit(False)).cast("int").alias("dim"),
        F.coalesce(F.col("definition").rlike("^(Faptul|Acțiunea) de a"), F.lit(False)).cast("int").alias("dev"),
        X.fold("word").alias("folded"),
    )


SHEET = E.Sheet(
    choices={"tier": ("tier", ["0", "1", "2"])},
    tags={"source": ("sources", [str(k) for k in range(1, 20)])},
    at_least={"min_occ": "occ", "min_dicts": "dict_count"},
    below={"before": "newest"}, from_={"after": "newest"}, present={"has_def": "definition"},
    equal={"band": ("tier", ["0", "1", "2"])}, scaled={"docs": ("docs", 0.1)},
    classes={"diminutives": (["dim"], "show"), "deverbal": (["dev"], "hide"), "derived": (["dim", "dev"], "show")},
)


def _filtered(name: str, params: dict, sql: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return words(spark, sf_dir).where(E.build_filter(SHEET, params)).select("word", "occ")

    QUERIES[name], ORACLES[name] = f, f"{WORDS} select word, occ from words where {sql}"


_filtered("flt_08", {"tier": "1,2", "source": ["1", "3"], "min_occ": 5, "after": 2010, "has_def": 1, "deverbal": "hide"},
          "tier in ('1', '2') and list_has_any(string_split(sources, '|'), ['1', '3']) and occ >= 5 and newest >= 2010 and definition is not null and dev = 0")
_filtered("flt_09", {"tier": "0,1,2", "deverbal": "show"}, "true")
_filtered("flt_10", {"derived": "only", "deverbal": "show"}, "dim = 1 or dev = 1")
_filtered("flt_11", {"min_occ": "10", "min_dicts": 2, "deverbal": "show"}, "occ >= 10 and dict_count >= 2")
_filtered("flt_12", {"tier": "1, 9,", "deverbal": "show"}, "tier = '1'")
_filtered("flt_13", {"source": "2", "deverbal": "show"}, "list_contains(string_split(sources, '|'), '2')")
_filtered("flt_14", {"source": "2,5,11", "deverbal": "show"}, "list_has_any(string_split(sources, '|'), ['2', '5', '11'])")
_filtered("flt_15", {"has_def": "0", "deverbal": "show"}, "definition is null")
_filtered("flt_16", {"before": "2018", "after": "2005", "deverbal": "show"}, "newest < 2018 and newest >= 2005")
_filtered("flt_17", {"band": "2", "deverbal": "show"}, "tier = '2'")
_filtered("flt_18", {"docs": "10-500", "deverbal": "show"}, "docs >= 1.0::double and docs <= 50.0::double")


@query(f"{WORDS} select word, occ from words where contains(lower(word), 'as') or contains(folded, 'as')", "flt_20")
def flt_19(spark, sf_dir):
    """A search text beats the filters."""
    return E.scope(words(spark, sf_dir), SHEET, {"q": "AS", "tier": "0"})[0].select("word", "occ")


@query(f"{WORDS} select word, occ from words where word in (select word from annotations where bookmarked = 1)")
def flt_21(spark, sf_dir):
    """The words of a playlist."""
    a = read(spark, sf_dir, "annotations").where("bookmarked = 1").select("word")
    return E.scope(words(spark, sf_dir), SHEET, {}, a)[0].select("word", "occ")


_MINE = "(select word from annotations where user_id = (select min(user_id) from annotations) and deleted = 0 and word is not null and (bookmarked = 1 or coalesce(note, '') <> '' or len(coalesce(tags, [])) > 0))"


@query(f"{WORDS} select 'marked' as kind, count(*) as n from words where word in {_MINE} union all select 'unmarked', count(*) from words where word not in {_MINE}", "flt_32")
def flt_22(spark, sf_dir):
    """Words that a user marked, and those left."""
    a = read(spark, sf_dir, "annotations")
    me, w = a.agg(F.min("user_id").alias("u")).first()["u"], publish(words(spark, sf_dir), "words")
    n = lambda k: E.by_marks(w, a, k, me).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n("marked").unionByName(n("unmarked"))


_REASON = "case when length(word) <= 5 then 'short' when definition is null then 'no_definition' when word like '% %' or word like '%-%' then 'several_words' when lower(word) <> word then 'capital' when occ = 0 then 'unseen' else 'kept' end"


@query(f"{WORDS} select {_REASON} as reason, count(*) as n from words group by 1")
def flt_03(spark, sf_dir):
    """Rows by the first rule that they fail."""
    w = F.col("word")
    reason = (
        F.when(F.length(w) <= 5, "short").when(F.col("definition").isNull(), "no_definition").when(w.contains(" ") | w.contains("-"), "several_words")
        .when(F.lower(w) != w, "capital").when(F.col("occ") == 0, "unseen").otherwise("kept")
    )
    return words(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


# stand-ins for lexemes: an article is one, with a frequency, a type of inflection and a description of its own
KINDS = ["F1", "M", "N", "A", "AF", "VT", "PT", "SP", "T", "I", "", "IL3"]
_KIND = "list_value(" + ", ".join(f"'{k}'" for k in KINDS) + ")[1 + def_id % 12]"
LEXEMES = f"(select distinct def_id, word as form, def_id % 102 / 100.0::double as frequency, {_KIND} as kind, replace(regexp_extract(definition, '^((?:s\\. [fmn]|adv|adj|vb)\\.)', 1), ' ', '') as description from definitions)"


def _lexemes(spark, sf_dir):
    d = read(spark, sf_dir, "definitions").select("def_id", "word", "definition").distinct()
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (1 + F.col("def_id") % 12).cast("int"))
    described = F.replace(F.regexp_extract("definition", r"^((?:s\. [fmn]|adv|adj|vb)\.)", 1), F.lit(" "), F.lit(""))
    return d.select("def_id", F.col("word").alias("form"), (F.col("def_id") % 102 / 100.0).alias("frequency"), kind.alias("kind"), described.alias("description"))


@query(f"""select def_id, case when regexp_matches(form, '^\\p{{Lu}}') then 'proper_noun' when regexp_matches(form, '^[A-Z][a-z]+ [A-Z]') or contains(form, ' ') or regexp_matches(form, '^[a-z]+-[a-z]+') then 'foreign'
when not coalesce(regexp_matches(lower(description), 'adj|s\\.m|s\\.f|s\\.n|vb|adv|interj|înv|reg|pop|dial|arh'), false) and regexp_extract(kind, '^[A-Z]+') not in ('A', 'N', 'F', 'M', 'VT', 'VI', 'IL', 'PT', 'P') then 'no_description' else 'kept' end as verdict
from {LEXEMES} where frequency > 0.01 and frequency < 1.0 and length(form) > 3""")
def flt_02(spark, sf_dir):
    """Candidates of a curated list, with the first rule that leaves each out."""
    return G.curated(_lexemes(spark, sf_dir)).select("def_id", "verdict")


@query("select norm as word, max(def_id) as def_id from (select nfc_normalize(translate(lower(word), 'şţ', 'șț')) as norm, def_id from definitions where length(word) > 2 and definition <> '') group by norm")
def flt_04(spark, sf_dir):
    """Candidates; of rows that normalize alike the last."""
    d = read(spark, sf_dir, "definitions").where("length(word) > 2 and definition <> ''")
    return d.groupBy(X.normalize("word").alias("word")).agg(F.max("def_id").alias("def_id"))


@query(f"select word from (select word, list(distinct value[1]) as v from {OBJ} where value is not null group by word) where list_has_any(v, ['b', 'c', 'd']) and not list_has_any(v, ['s'])")
def flt_06(spark, sf_dir):
    """Words with tags of one kind and none of another."""
    o = _object_tags(spark, sf_dir).where("value is not null").groupBy("word").agg(F.collect_set(F.substring("value", 1, 1)).alias("v"))
    arr = lambda *x: F.array(*map(F.lit, x))
    return o.where(F.arrays_overlap("v", arr("b", "c", "d")) & ~F.arrays_overlap("v", arr("s"))).select("word")


@query("select distinct def_id, cast(coalesce(trim(definition, ' '), '') = '' or starts_with(lower(trim(definition, ' ')), '[fără definiț') as int) as placeholder from definitions")
def flt_07(spark, sf_dir):
    """Definitions that say nothing."""
    t = F.coalesce(F.trim("definition"), F.lit(""))
    return read(spark, sf_dir, "definitions").select("def_id", ((t == "") | F.lower(t).startswith("[fără definiț")).cast("int").alias("placeholder")).distinct()


_SEG = "trim(string_split(definition, '|')[1], ' ')"


@query(f"""{WORDS} select word from words where not regexp_matches(word, '^\\p{{Lu}}') and coalesce(newest, 9999) >= 2000 and dim = 0 and dict_count >= 3 and length({_SEG}) >= 12
and lower({_SEG}) not like 'vezi %' and lower({_SEG}) not like 'diminutiv%' and lower({_SEG}) not like 'augmentativ%' and {_SEG} not like '%:' and {_SEG} not glob '[A-Z][A-Z]*'""")
def flt_23(spark, sf_dir):
    """Words that can be asked about. Stand-ins: words in capitals are proper nouns, those of old editions
    only have old spellings, diminutives are variants."""
    flags = {"proper": F.col("word").rlike(r"^\p{Lu}").cast("int"), "archaic": (F.coalesce("newest", F.lit(9999)) < 2000).cast("int")}
    return words(spark, sf_dir).withColumns(flags).where(G.fair_question(["proper", "archaic", "dim"])).select("word")


@query(f"{WORDS} select word from words where tier = '2' and definition is not null and not regexp_matches(word, '^\\p{{Lu}}') and dict_count >= 3")
def flt_24(spark, sf_dir):
    """Words that may be the word of a day: of one tier, defined, no proper nouns, in 3 dictionaries."""
    w = words(spark, sf_dir)
    return w.where((F.col("tier") == "2") & F.col("definition").isNotNull() & ~F.col("word").rlike(r"^\p{Lu}") & (F.col("dict_count") >= 3)).select("word")


@query(f"{WORDS} select word, concat_ws(',', case when dim = 1 then 'diminutives' end, case when dev = 1 then 'deverbal' end, case when tier = '0' then 'tier' end) as relax from words")
def flt_25(spark, sf_dir):
    """Which usual filters would hide a word."""
    w = F.concat_ws(",", F.when(F.col("dim") == 1, "diminutives"), F.when(F.col("dev") == 1, "deverbal"), F.when(F.col("tier") == "0", "tier"))
    return words(spark, sf_dir).select("word", w.alias("relax"))


@query(f"{WORDS} select word from words where occ >= 100 and word not in (select lemma from form_lemma where lemma is not null)")
def flt_26(spark, sf_dir):
    """Frequent headwords that no form covers: a difference of sets."""
    f = read(spark, sf_dir, "form_lemma").select(F.col("lemma").alias("word"))
    return words(spark, sf_dir).where("occ >= 100").join(f, "word", "left_anti").select("word")


@query("with todo as (select lemma as word, min(form_id) as o from form_lemma where lemma is not null group by 1) select word, o from todo where word not in (select word from definitions where word is not null and source_id = 5) and word not in (select word from annotations where word is not null and user_id % 5 = 0 and deleted = 1) order by o limit 50")
def flt_27(spark, sf_dir):
    """What is left to do, less what is done and what was tried, in order; the first 50. Stand-ins: words of
    one edition are done, what every fifth user deleted was tried."""
    f, d, a = read(spark, sf_dir, "form_lemma", "definitions", "annotations")
    todo = f.where("lemma is not null").groupBy(F.col("lemma").alias("word")).agg(F.min("form_id").alias("o"))
    tried = a.where("user_id % 5 = 0 and deleted = 1")
    return todo.join(d.where("source_id = 5"), "word", "left_anti").join(tried, "word", "left_anti").select("word", "o").orderBy("o").limit(50)


_HOST = "'https://' || case source_id when 1 then 'www.exemplu.ro' when 2 then 'altexemplu.ro' else 'exemplu.ro' end || '/x?y=1'"


@query("select distinct def_id from definitions where source_id = 2")
def flt_28(spark, sf_dir):
    """Results whose host is none of some sites or under them."""
    d = read(spark, sf_dir, "definitions").select("def_id", F.expr(_HOST).alias("url")).distinct()
    host = F.parse_url("url", F.lit("HOST"))
    return d.where(~((host == "exemplu.ro") | host.endswith(".exemplu.ro"))).select("def_id")


@query(f"{WORDS} select word from words where occ between 5 and 500 and regexp_matches(word, '^\\p{{Ll}}') and coalesce(dict_count < 4, true)")
def flt_29(spark, sf_dir):
    """A range of frequency, loans and proper nouns hidden."""
    return words(spark, sf_dir).where(F.col("occ").between(5, 500) & F.col("word").rlike(r"^\p{Ll}") & F.coalesce(F.col("dict_count") < 4, F.lit(True))).select("word")


@query("select count(*) as n_rows, count(*) filter (word is null) as no_word, count(*) filter (updated_at is null) as no_time, count(*) filter (word is not null and updated_at is not null) as ok from annotations")
def flt_30(spark, sf_dir):
    """Rows that lack something, tallied."""
    w, t = F.col("word").isNull(), F.col("updated_at").isNull()
    return read(spark, sf_dir, "annotations").agg(F.count("*").alias("n_rows"), F.count_if(w).alias("no_word"), F.count_if(t).alias("no_time"), F.count_if(~w & ~t).alias("ok"))


@query("with p as (select distinct word, source_id from definitions where word is not null and source_id is not null and source_id not in (1, 2)) select word, string_agg(source_id || '', ',' order by source_id) as editions from p group by word order by word limit 200")
def flt_31(spark, sf_dir):
    """Pairs of word and edition still to be done, by word; the first 200."""
    p = read(spark, sf_dir, "definitions").where("word is not null and source_id is not null").select("word", "source_id").distinct()
    p = p.join(spark.createDataFrame([(1,), (2,)], "source_id int"), "source_id", "left_anti")
    return p.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list("source_id")), lambda x: x.cast("string")), ",").alias("editions")).orderBy("word").limit(200)


# --- order, pages, samples ---------------------------------------------------------------------------

@query(f"{WORDS} select word, newest from words order by newest asc nulls last, word limit 250")
def srt_01(spark, sf_dir):
    """A named order with nulls last; the first page."""
    return E.page(words(spark, sf_dir), E.ordered(None, [F.col("newest").asc_nulls_last()])).select("word", "newest")


VOTES = "(select word, cast(sum(case when bookmarked = 1 or coalesce(list_contains(tags, 'lol'), false) then 1 when coalesce(list_contains(tags, 'meh'), false) then -1 else 0 end) as bigint) as votes from annotations where deleted = 0 group by word)"
_PTS = "(case " + " ".join(f"when abs(v) <= {n} then {p}" for n, p in E.VOTE_STEPS) + f" else {E.MOST_POINTS} end * case when v < 0 then -1 else 1 end)"


@query(f"{WORDS} select word, dict_count + {_PTS} as points from (select w.*, coalesce(v.votes, 0) as v from words w left join {VOTES} v using (word)) order by points desc, dict_count desc, word limit 250")
def srt_02(spark, sf_dir):
    """By a quality with a boost from votes."""
    v = M.votes(read(spark, sf_dir, "annotations"))
    w = words(spark, sf_dir).join(v, "word", "left").withColumn("points", F.col("dict_count") + E.vote_points(F.coalesce("votes", F.lit(0))))
    return E.page(w, E.ordered(None, [F.desc("points"), F.desc("dict_count")])).select("word", "points")


@query(f"{WORDS} select word, occ from words order by word <> (select max(word) from words), starts_with(word, 's'), occ desc, word limit 100")
def srt_03(spark, sf_dir):
    """A word pinned on top, words with one beginning last."""
    w = publish(words(spark, sf_dir), "words")
    pin = w.agg(F.max("word").alias("w")).first()["w"]
    return E.page(w, E.ordered(None, [F.desc("occ")], demote="s", pin=pin), size=100).select("word", "occ")


@query(f"{WORDS} select word, occ from words order by occ desc, word limit 250 offset 250")
def srt_04(spark, sf_dir):
    """The second page."""
    return E.page(words(spark, sf_dir), E.ordered(None, [F.desc("occ")]), 2).select("word", "occ")


_SEAM = "case when dict_count >= 3 then 'relevant' else 'curiosity' end"


@query(f"{WORDS} select word, {_SEAM} as seam, row_number() over (order by {_SEAM} <> 'relevant', dict_count desc, case tier when '2' then 0 when '1' then 1 else 2 end, occ desc, word) as place from words")
def srt_05(spark, sf_dir):
    """All words by seam, falling score, tier and falling frequency, with their places."""
    w = words(spark, sf_dir).select("word", F.when(F.col("dict_count") >= 3, "relevant").otherwise("curiosity").alias("seam"), "dict_count", "tier", "occ")
    k = w.select("word", "seam", (F.col("seam") != "relevant").cast("int").alias("s"), (-F.col("dict_count")).alias("q"), (2 - F.col("tier").cast("int")).alias("t"), (-F.col("occ")).alias("o"))
    return global_rank(k, ["s", "q", "t", "o", "word"], "place").select("word", "seam", "place")


@query(f"""{WORDS} select 'occurrences' as result, word from (select word from words order by occ desc, word limit 20)
union all select 'documents', word from (select word from words order by docs desc, word limit 30)
union all select 'tier ' || tier, word from (select tier, word, row_number() over (partition by tier order by dict_count desc, occ desc, word) as k from words) where k <= 200""")
def srt_06(spark, sf_dir):
    """The top of each of several results: 20 by occurrences, 30 by documents, 200 of each tier."""
    w = publish(words(spark, sf_dir), "words")
    top = lambda df, name, n, *keys: E.page(df, E.ordered(None, list(keys)), size=n).select(F.lit(name).alias("result"), "word")
    out = top(w, "occurrences", 20, F.desc("occ")).unionByName(top(w, "documents", 30, F.desc("docs")))
    for t in ("0", "1", "2"):
        out = out.unionByName(top(w.where(F.col("tier") == t), f"tier {t}", 200, F.desc("dict_count"), F.desc("occ")))
    return out


_ONE = "select word, occ, row_number() over (partition by folded order by word <> folded, occ desc, word) as k from"


@query(f"""{WORDS} select 'after' as taken, word from (select word from ({_ONE} words) where k = 1 order by occ desc, word limit 1000)
union all select 'before', word from ({_ONE} (select * from words order by occ desc, word limit 1000)) where k = 1""")
def srt_08(spark, sf_dir):
    """The first 1000, of words that fold alike one: the limit taken after that and the sort, or before."""
    w = publish(words(spark, sf_dir).select("word", "occ", "folded"), "words")
    one = lambda df: first_per_key(df, ["folded"], [F.col("word") != F.col("folded"), -F.col("occ"), "word"])
    first = lambda df: E.page(df, E.ordered(None, [F.desc("occ")]), size=1000)
    return first(one(w)).select(F.lit("after").alias("taken"), "word").unionByName(one(first(w)).select(F.lit("before").alias("taken"), "word"))


@query("select tree_id, string_agg(breadcrumb, ',' order by list_transform(regexp_extract_all(breadcrumb, '\\d+'), lambda x: cast(x as bigint)), meaning_id) as crumbs from (select distinct meaning_id, tree_id, breadcrumb from meanings where breadcrumb <> '') group by tree_id")
def srt_07(spark, sf_dir):
    """Breadcrumbs in the order of their numbers."""
    m = read(spark, sf_dir, "meanings").where("breadcrumb <> ''").select("meaning_id", "tree_id", "breadcrumb").distinct()
    items = F.array_sort(F.collect_list(F.struct(X.crumb_key("breadcrumb").alias("k"), "meaning_id", "breadcrumb")))
    return m.groupBy("tree_id").agg(F.array_join(F.transform(items, lambda x: x["breadcrumb"]), ",").alias("crumbs"))


@query(f"{WORDS} select word from words where definition is not null order by md5(word || '#7'), word limit 20")
def srt_09(spark, sf_dir):
    """20 words at random, the same ones for one seed."""
    return S.sample(words(spark, sf_dir).where("definition is not null"), "word", 20, 7).select("word")


@query(f"{WORDS} select word from words order by word limit 1 offset (select 20000 % count(*) from words)")
def srt_10(spark, sf_dir):
    """The word of a day."""
    return S.of_the_day(publish(words(spark, sf_dir), "words"), "word", 20_000).select("word")


@query("select lang, doc_id from (select *, row_number() over (partition by lang order by md5(doc_id || '#3'), doc_id) as k from (select distinct doc_id, coalesce(lang, '?') as lang from documents)) where k <= 5")
def srt_11(spark, sf_dir):
    """Five documents of each language."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang")).distinct()
    return S.stratified(d, "lang", "doc_id", 5, 3).select("lang", "doc_id")


@query(f"{WORDS}, t as (select word as target, dict_count as c from words order by md5(word || '#1'), word limit 1), o as (select w.word, row_number() over (order by w.dict_count = t.c desc, md5(w.word || '#2'), w.word) as k from words w, t where w.word <> t.target) select target as word, 1 as is_target from t union all select word, 0 from o where k <= 3")
def srt_12(spark, sf_dir):
    """A quiz: one target and three others, those of its kind first."""
    w = publish(words(spark, sf_dir).select("word", "dict_count"), "words")
    t = w.orderBy(S.order_key("word", 1), "word").limit(1).first()
    if t is None:
        return w.limit(0).select("word", F.lit(0).alias("is_target"))
    rest = w.where(F.col("word") != t["word"]).orderBy((F.col("dict_count") == t["dict_count"]).desc(), S.order_key("word", 2), "word").limit(3)
    return w.where(F.col("word") == t["word"]).select("word", F.lit(1).alias("is_target")).unionByName(rest.select("word", F.lit(0).alias("is_target")))


@query(f"{WORDS} select word, occ from words where word in (select word from annotations) order by word in (select word from annotations where deleted = 0 and word is not null), word limit 100")
def srt_14(spark, sf_dir):
    """An audit list, rows that are done at the bottom."""
    a = read(spark, sf_dir, "annotations").where("word is not null")
    done = a.groupBy("word").agg(F.max((F.col("deleted") == 0).cast("int")).alias("done"))
    return words(spark, sf_dir).join(done, "word").orderBy("done", "word").limit(100).select("word", "occ")


# --- sets --------------------------------------------------------------------------------------------


@query("select word from definitions where word is not null union select lemma from form_lemma where lemma is not null", "set_02")
def set_01(spark, sf_dir):
    """A union without repeats."""
    d, f = read(spark, sf_dir, "definitions", "form_lemma")
    return d.where("word is not null").select("word").union(f.where("lemma is not null").select("lemma")).distinct()


EXPECTED = ["romane_vechi", "web_azi", "parlament", "reviste"]


@query(f"""{WORDS} select 'uncovered' as kind, word as item from words where occ >= 100 and word not in (select lemma from form_lemma where lemma is not null)
union all (select 'capital', lower(word) from corpus_word_frequency where regexp_matches(word, '^\\p{{Lu}}') except select 'capital', word from corpus_word_frequency)
union all (select 'unsampled', word from annotations where word is not null except select 'unsampled', word from definitions)
union all (select 'corpus', unnest({EXPECTED!r}) except select 'corpus', corpus_name from corpus_word_frequency)""")
def set_03(spark, sf_dir):
    """Four differences: frequent headwords less those covered, words in capitals less those in small letters,
    a sample less what is there, corpora expected less those complete."""
    f, c, a, d = read(spark, sf_dir, "form_lemma", "corpus_word_frequency", "annotations", "definitions")
    less = lambda kind, x, y: x.select(F.col(x.columns[0]).alias("item")).where("item is not null").distinct().join(y.select(F.col(y.columns[0]).alias("item")), "item", "left_anti").select(F.lit(kind).alias("kind"), "item")
    want = spark.createDataFrame([(x,) for x in EXPECTED], "item string")
    return (
        less("uncovered", words(spark, sf_dir).where("occ >= 100").select("word"), f.select("lemma"))
        .unionByName(less("capital", c.where(F.col("word").rlike(r"^\p{Lu}")).select(F.lower("word")), c.select("word")))
        .unionByName(less("unsampled", a.select("word"), d.select("word"))).unionByName(less("corpus", want, c.select("corpus_name")))
    )


@query("select distinct user_id, seq, cast(coalesce(list_has_any(tags, ['lol', 'meh']), false) as int) as voted from annotations")
def set_04(spark, sf_dir):
    """Whether two sets of tags meet."""
    t = F.coalesce(F.arrays_overlap("tags", F.array(F.lit("lol"), F.lit("meh"))), F.lit(False))
    return read(spark, sf_dir, "annotations").select("user_id", "seq", t.cast("int").alias("voted")).distinct()


@query("select word, string_agg(distinct k, '|' order by k) as kinds from (select word, 'd' || source_id as k from definitions where word is not null and source_id is not null union select word, 'm' || type from meanings where word is not null and type is not null) group by word")
def set_05(spark, sf_dir):
    """Two paths united into one set per word."""
    d, m = read(spark, sf_dir, "definitions", "meanings")
    k = d.select("word", F.concat(F.lit("d"), F.col("source_id").cast("string")).alias("k")).union(m.select("word", F.concat(F.lit("m"), F.col("type").cast("string"))))
    return k.where("word is not null and k is not null").groupBy("word").agg(F.array_join(F.sort_array(F.collect_set("k")), "|").alias("kinds"))


@query("select distinct word from annotations where word in (select word from definitions)")
def set_06(spark, sf_dir):
    """Incoming words that are known."""
    a, d = read(spark, sf_dir, "annotations", "definitions")
    return a.select("word").distinct().join(d.select("word"), "word", "left_semi")


@query("select user_id, word, row_number() over (partition by user_id order by min(seq), word) as nth from annotations where word is not null group by 1, 2")
def set_07(spark, sf_dir):
    """Distinct words in the order of their first appearance."""
    a = read(spark, sf_dir, "annotations").where("word is not null").select("user_id", "word", "seq")
    return global_rank(distinct_in_order(a, ["user_id", "word"], "seq"), ["seq", "word"], "nth", ["user_id"]).select("user_id", "word", "nth")


# --- communities -------------------------------------------------------------------------------------

STATE = "(select * from (select *, row_number() over (partition by user_id, word order by updated_at desc, seq, deleted desc) as k from annotations where word is not null and updated_at is not null and user_id is not null) where k = 1)"


@query(f"select word, cast(sum(case when bookmarked = 1 then 1 else 0 end) as bigint) as bookmarks, count(*) as users from {STATE} where deleted = 0 group by word")
def agg_13(spark, sf_dir):
    """Bookmarks of a word in the state of now."""
    s = apply_changes(read(spark, sf_dir, "annotations"), payload=("bookmarked",)).where("deleted = 0")
    return s.groupBy("word").agg(F.sum(F.when(F.col("bookmarked") == 1, 1).otherwise(0)).alias("bookmarks"), F.count("*").alias("users"))


_LOL, _MEH = "coalesce(list_contains(tags, 'lol'), false)", "coalesce(list_contains(tags, 'meh'), false)"


@query(f"select word, count(*) filter (bookmarked = 1) as n_fav, count(*) filter ({_LOL}) as n_lol, count(*) filter (bookmarked = 1 or {_LOL}) as n_up, count(*) filter ({_MEH}) as n_down from annotations where deleted = 0 group by word")
def agg_14(spark, sf_dir):
    """Marks of a word by kind."""
    return M.mark_counts(read(spark, sf_dir, "annotations"))


@query(f"select count(*) filter (votes > 0) as liked, count(*) filter (votes < 0) as disliked, (select count(distinct user_id) from annotations where deleted = 0) as people from {VOTES}")
def agg_15(spark, sf_dir):
    """Counters of tabs, and people."""
    a = read(spark, sf_dir, "annotations")
    people = a.where("deleted = 0").select("user_id").distinct().where("user_id is not null").count()
    return M.votes(a).agg(F.count_if(F.col("votes") > 0).alias("liked"), F.count_if(F.col("votes") < 0).alias("disliked")).withColumn("people", F.lit(people).cast("long"))


@query("select word, count(*) as n, min(seq) as first_seq, string_agg(distinct nullif(note, ''), ' | ' order by nullif(note, '')) as notes from (select distinct user_id, word, seq, note from annotations where word is not null) group by word")
def agg_17(spark, sf_dir):
    """A queue: number, first, and reasons without the empty ones."""
    a = read(spark, sf_dir, "annotations").where("word is not null").select("user_id", "word", "seq", "note").distinct()
    notes = F.nullif(F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("note"), F.lit("")))), " | "), F.lit(""))
    return a.groupBy("word").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), notes.alias("notes"))


@query("select distinct user_id, unnest(tags) as tag from annotations where deleted = 0 except select user_id, t from (select distinct user_id from annotations), (values ('lol'), ('meh')) v(t)")
def agg_30(spark, sf_dir):
    """Tags of a user besides the usual ones."""
    a = read(spark, sf_dir, "annotations").where("deleted = 0").select("user_id", F.explode("tags").alias("tag")).distinct()
    return a.join(spark.createDataFrame([("lol",), ("meh",)], "tag string"), "tag", "left_anti").select("user_id", "tag")


@query(f"select user_id, case when bool_or(bookmarked = 1) then 'pick' when bool_or({_MEH}) then 'demote' else 'none' end as choice from annotations where deleted = 0 group by user_id")
def cls_22(spark, sf_dir):
    """Which mark decides."""
    a = read(spark, sf_dir, "annotations").where("deleted = 0")
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    return a.groupBy("user_id").agg(F.when(any_(F.col("bookmarked") == 1), "pick").when(any_(F.array_contains("tags", "meh")), "demote").otherwise("none").alias("choice"))


ANSWERS = "(select user_id, event_type as mode, ts, event_id, cast(value >= 10 as int) as ok from events where user_id is not null and value is not null)"
STREAKS = f"""
with a as (select * from {ANSWERS} union all select user_id, 'all', ts, event_id, ok from {ANSWERS}),
i as (select *, sum(1 - ok) over (partition by user_id, mode order by ts, event_id rows unbounded preceding) as island from a),
p as (select user_id, mode, island, sum(ok) as len, count(*) as n from i group by all),
s as (select user_id as "user", mode, cast(sum(n) as bigint) as answers, cast(sum(len) as bigint) as correct, cast(max(len) as bigint) as best, cast(arg_max(len, island) as bigint) as current from p group by all)
"""


def _answers(df: DataFrame) -> DataFrame:
    return df.where("user_id is not null and value is not null").select("user_id", F.col("event_type").alias("mode"), "ts", "event_id", (F.col("value") >= 10).cast("int").alias("ok"))


@query(f"{STREAKS} select * from s")
def win_09(spark, sf_dir):
    """Runs of right answers of each user, by mode and over all."""
    return M.streaks(_answers(read(spark, sf_dir, "events")), "user_id", "mode", ["ts", "event_id"], "ok")


@query(f"{STREAKS} select \"user\", best, correct from s where mode = 'all' order by best desc, correct desc, \"user\" limit 50")
def win_08(spark, sf_dir):
    """The leaderboard."""
    s = win_09(spark, sf_dir).where("mode = 'all'")
    return M.leaderboard(s).select("user", "best", "correct")


@query(f"{STREAKS}, me as (select min(\"user\") as u from s where mode = 'all') select u as \"user\", b.best, (select count(*) + 1 from s where mode = 'all' and best > b.best) as place from me join s b on b.\"user\" = u and b.mode = 'all'")
def win_08_own(spark, sf_dir):
    """A user's own place."""
    s = publish(win_09(spark, sf_dir).where("mode = 'all'"), "stats")
    return M.own_place(s, s.agg(F.min("user").alias("u")).first()["u"])


# --- flags -------------------------------------------------------------------------------------------

# rules written out in SQL, apart from those of the operators
_SUFFIX = "('uleț', ''), ('uliță', 'ă'), ('ișor', ''), ('ișoară', 'ă'), ('cioară', 'ă'), ('șoară', 'ă'), ('șor', ''), ('uță', 'ă'), ('uț', '')"
_DIM = "regexp_matches(definition, '(?:^|\\|)\\s*(?:\\([^)]{0,40}\\)\\s*)?[Dd]iminutiv[\\pL\\pN_]*\\s+(?:al|a|ale|lui|de\\s+la)(?:[^\\pL\\pN_]|$)')"
# every other word has a diminutive, and stands in an old spelling with a fiftieth of its count
_OLD = "case when starts_with(w, 'tr') then 'adv' || substr(w, 3) else w || 'țiune' end"
_NEW = "case when starts_with(w, 'tr') then 'av' || substr(w, 3) else w || 'ție' end"


def _made(w: DataFrame, c) -> DataFrame:
    return w.where(F.length("word") % 2 == 0).select(c.alias("word"), F.col("occ"))


@query(f"""{WORDS}, w as (select word, definition from words union all select word || 'uliță', null from words where length(word) % 2 = 0 union all select word || 'uț', null from words where length(word) % 2 = 0),
s as (select word, left(lower(word), length(word) - length(e)) || r as base, length(word) - length(e) as n from w, (values {_SUFFIX}) v(e, r) where ends_with(lower(word), e)),
h as (select distinct word from s where n > 2 and base <> lower(word) and base in (select lower(form) from form_lemma where form <> ''))
select w.word, cast(max(cast(coalesce({_DIM}, false) or h.word is not null as int)) as int) as diminutive from w left join h on h.word = w.word group by w.word""")
def cls_09(spark, sf_dir):
    """Diminutives by definition or by ending. Stand-ins: words of even length also stand with two endings."""
    w = publish(words(spark, sf_dir).select("word", "definition", "occ"), "words")
    both = w.select("word", "definition")
    for e in ("uliță", "uț"):
        both = both.unionByName(_made(w, F.concat("word", F.lit(e))).select("word", F.lit(None).cast("string").alias("definition")))
    return G.diminutives(both, read(spark, sf_dir, "form_lemma")).groupBy("word").agg(F.max("diminutive").alias("diminutive"))


@query(f"""{WORDS}, m as (select word as w, occ from words where length(word) % 2 = 0),
x as (select word, occ from words union all select {_OLD}, occ // 50 from m union all select {_NEW}, occ from m), y as (select word, max(occ) as occ from x group by 1),
r as (select word, occ, i, regexp_replace(word, a, b) as modern from y, (values (0, 'țiune$', 'ție'), (1, 'ziune$', 'zie'), (2, 'siune$', 'sie'), (5, '^adv', 'av')) v(i, a, b)
  union all select word, occ, 3, 'z' || substr(word, 2) from y where regexp_matches(word, '^s[bdg]') union all select word, occ, 4, 'dez' || substr(word, 4) from y where regexp_matches(word, '^des[bdgjlmnrv]'))
select r.word, arg_min(modern, i) as modern from r join y on y.word = r.modern where modern <> r.word and y.occ >= 20 * greatest(r.occ, 1) group by r.word""")
def cls_10(spark, sf_dir):
    """Old spellings of frequent words. Stand-ins: words of even length also stand with an old ending or
    beginning, with a fiftieth of their count, and with the new one."""
    w = publish(words(spark, sf_dir).select("word", "occ"), "words")
    tr = F.col("word").startswith("tr")
    rest = F.expr("substr(word, 3)")
    old = _made(w, F.when(tr, F.concat(F.lit("adv"), rest)).otherwise(F.concat("word", F.lit("țiune")))).withColumn("occ", F.floor(F.col("occ") / 50))
    new = _made(w, F.when(tr, F.concat(F.lit("av"), rest)).otherwise(F.concat("word", F.lit("ție"))))
    y = publish(w.unionByName(old).unionByName(new).groupBy("word").agg(F.max("occ").alias("n")), "spellings")
    return G.archaic_spellings(y.withColumnRenamed("n", "own"), y)


_POINTER = "nfc_normalize(translate(lower(regexp_extract(definition, '(?i)^\\s*vezi\\s+([^\\s,;.]+)\\s*\\.?\\s*$', 1)), 'şţ', 'șț'))"
# the tables' letters as single bytes, for an edit distance by character
_BYTES = "translate({}, 'ăâîșțĂÂÎȘȚ', '0123456789')"


@query(f"""{WORDS}, e as (select distinct lemma as entry, nfc_normalize(translate(lower(form), 'şţ', 'șț')) as form, cast(form_id % 5 <> 0 and form = lemma as int) as main from form_lemma where lemma is not null and form <> ''),
hd as (select distinct form as head from e where main = 1), pr as (select distinct a.form as variant, b.form as head from e a join e b using (entry) where a.main = 0 and b.main = 1 and a.form <> b.form),
sf as (select word, cast(sum(coalesce(occurrence_count, 0)) as bigint) as n from (select distinct on (id) * from corpus_word_frequency where word is not null and corpus_name is not null) group by word),
pg as (select lemma, cast(sum(n) as bigint) as n from (select distinct form, lemma from form_lemma where form is not null and lemma is not null) join sf on sf.word = form group by 1),
hc as (select head, max(n) as n from (select word as head, n from sf union all select lemma, n from pg) group by 1),
a as (select word, definition from words union all select form, null from e where main = 0 and form not in (select word from words)),
w as (select distinct a.word, {_POINTER} as pointer, 20 * greatest(coalesce(sf.n, 0), 1) as floor from a left join sf using (word)),
k as (select * from w where coalesce(pointer, '') <> '' or word not in (select head from hd)),
nm as (select k.word, k.pointer as head from k join hc on hc.head = k.pointer where pointer <> word and hc.n >= floor),
cd as (select k.word, floor, pr.head, coalesce(hc.n, 0) as n, row_number() over (partition by k.word order by levenshtein({_BYTES.format("k.word")}, {_BYTES.format("pr.head")}), coalesce(hc.n, 0) desc, pr.head) as r
  from k join pr on pr.variant = k.word left join hc on hc.head = pr.head where k.word not in (select word from nm))
select word as variant, head from nm union all select word, head from cd where r = 1 and n >= floor""")
def cls_11(spark, sf_dir):
    """Variants of far more frequent heads. Stand-ins: a lemma is an entry, its forms stand in it, and the
    one equal to it is main in four of five entries; these forms are words of the list too."""
    w = words(spark, sf_dir).select("word", "definition")
    f = read(spark, sf_dir, "form_lemma").where("lemma is not null and form <> ''")
    e = f.select(F.col("lemma").alias("entry_id"), "form", ((F.col("form_id") % 5 != 0) & (F.col("form") == F.col("lemma"))).cast("int").alias("main")).distinct()
    n = publish(_counts(spark, sf_dir, False).select("word", F.col("occurrences").alias("n")), "counts")
    p = _claims(spark, sf_dir).join(n.withColumnRenamed("word", "form"), "form").groupBy("lemma").agg(F.sum("n").alias("n"))
    beside = e.where("main = 0").select(X.normalize("form").alias("word")).distinct().join(w, "word", "left_anti").withColumn("definition", F.lit(None).cast("string"))
    return G.variants(w.unionByName(beside).withColumn("archaic", F.lit(0)), e, n, p)


_VERB = "nfc_normalize(translate(lower(regexp_extract(trim(string_split(definition, '|')[1], ' '), '(?i)^\\s*(?:Faptul|Ac[țt]iunea)\\s+de\\s+a\\s+(?:\\(\\s*se\\s*\\)\\s+|se\\s+)?(\\pL+)', 1)), 'şţ', 'șț'))"


@query(f"""{WORDS}, n as (select word, dim, {_SEAM} as seam, coalesce({_VERB}, '') as verb from words),
v as (select word, dim, seam from n union all select distinct verb, 0, case when length(verb) % 4 = 0 then 'relevant' else 'curiosity' end from n where verb <> '' and length(verb) % 2 = 0)
select distinct n.word, n.verb from n join v on v.word = n.verb where n.verb <> '' and n.verb <> n.word and v.dim = 0 and (v.seam = n.seam or v.seam = 'relevant')""", "jon_23")
def cls_12(spark, sf_dir):
    """Nouns that name a verb's act. Stand-ins: the verbs of even length that are named are words of the list,
    half of them in the more visible seam."""
    seam = F.when(F.col("dict_count") >= 3, "relevant").otherwise("curiosity")
    w = publish(words(spark, sf_dir).select("word", "definition", "dim", seam.alias("seam")), "words")
    verb = X.normalize(F.regexp_extract(F.trim(X.first_segment("definition")), G.DEVERBAL, 1))
    v = w.select(verb.alias("word")).where("word <> '' and length(word) % 2 = 0").distinct()
    v = v.select("word", F.lit("").alias("definition"), F.lit(0).alias("dim"), F.when(F.length("word") % 4 == 0, "relevant").otherwise("curiosity").alias("seam"))
    return G.deverbal(w.unionByName(v), ["dim", "missing_flag"], seam="seam")


_CLASSES = "map {'F': 'substantiv feminin', 'M': 'substantiv masculin', 'N': 'substantiv neutru', 'A': 'adjectiv', 'AF': 'adjectiv', 'AM': 'adjectiv', 'AN': 'adjectiv', 'V': 'verb', 'VT': 'verb', 'VI': 'verb', 'PT': 'participiu', 'P': 'pronume', 'SP': 'nume propriu'}"
_DESCRIBED = "map {'adv.': 'adverb', 'interj.': 'interjecție', 'adj.': 'adjectiv', 'prep.': 'prepoziție', 'conj.': 'conjuncție', 'pron.': 'pronume', 's.f.': 'substantiv feminin', 's.m.': 'substantiv masculin', 's.n.': 'substantiv neutru', 'vb.': 'verb', 'part.': 'participiu'}"


@query(f"select form as word, string_agg(distinct c, '|' order by c) as kinds from (select lower(form) as form, coalesce(({_CLASSES})[kind], ({_DESCRIBED})[description]) as c from {LEXEMES} where form <> '') where c is not null group by 1")
def cls_14(spark, sf_dir):
    """Word classes by type of inflection, else by description."""
    x = _lexemes(spark, sf_dir).where("form <> ''").select(F.lower("form").alias("word"), G.word_class(F.col("kind"), F.col("description")).alias("kind")).where("kind is not null")
    return x.groupBy("word").agg(F.array_join(F.sort_array(F.collect_set("kind")), "|").alias("kinds"))


@query("select lower(form) as word, min(cast(upper(left(form, 1)) = left(form, 1) and lower(form) <> form as int)) as proper from form_lemma where form is not null group by 1")
def cls_15(spark, sf_dir):
    """Forms that are capitalized wherever they stand."""
    return G.proper_nouns(read(spark, sf_dir, "form_lemma"), "form")


@query("select distinct def_id, cast(case when definition like '%(Înv.)%' then 1 else 0 end + case when definition like '%(Pop.)%' then 2 else 0 end + case when definition like '%(Rar)%' then 4 else 0 end as int) as bits from definitions")
def cls_17(spark, sf_dir):
    """Registers as bits."""
    return read(spark, sf_dir, "definitions").select("def_id", G.register_bits(F.col("definition"), ["(Înv.)", "(Pop.)", "(Rar)"]).cast("int").alias("bits")).distinct()


# --- sense trees -------------------------------------------------------------------------------------

M1 = "m1 as (select meaning_id, arg_max(word, md) as word, arg_max(tree_id, md) as tree_id, arg_max(type, md) as type, arg_max(coalesce(breadcrumb, ''), md) as breadcrumb, arg_max(coalesce(display_order, 0), md) as display_order, arg_max(coalesce(text, ''), md) as text from (select *, coalesce(mod_date, -1) as md from meanings) group by 1)"
UNITS = f"{M1}, u as (select tree_id, meaning_id, word, text, type, row_number() over (partition by tree_id order by type <> 0, case when type = 0 then list_transform(regexp_extract_all(breadcrumb, '\\d+'), lambda x: cast(x as bigint)) else [] end, display_order, meaning_id) - 1 as ord from m1 where type in (0, 4, 5) and trim(text, ' ') <> '')"
ATT = f"{_EDGES}, {UNITS}, up as (select r.node_id, unnest(string_split(node_path, '/')) as a, generate_subscripts(string_split(node_path, '/'), 1) as pos from r join m1 on m1.meaning_id = r.node_id and m1.type = 2 where r.table_name = 'meanings'), att as (select node_id as meaning_id, arg_max(cast(a as bigint), pos) as unit_id from up where cast(a as bigint) <> node_id and cast(a as bigint) in (select meaning_id from u) group by 1)"


def _m1(spark, sf_dir):
    m = read(spark, sf_dir, "meanings")
    pick = lambda c, d=None: F.max_by(F.coalesce(c, F.lit(d)) if d is not None else F.col(c), F.coalesce("mod_date", F.lit(-1))).alias(c)
    return m.groupBy("meaning_id").agg(pick("word"), pick("tree_id"), pick("type"), pick("breadcrumb", ""), pick("display_order", 0), pick("text", ""))


@query(f"with {UNITS} select tree_id, meaning_id, ord from u")
def tre_01(spark, sf_dir):
    """The units of each tree in order."""
    return T.units(_m1(spark, sf_dir)).select("tree_id", "meaning_id", "ord")


def _attached(spark, sf_dir, m1, u):
    tree = hierarchy(_nodes(spark, sf_dir).where("space = 'meanings'"))
    return T.attach(tree, u, m1.where(F.col("type") == T.CITATION))


@query(f"{ATT} select meaning_id, unit_id from att")
def tre_02(spark, sf_dir):
    """Citations and the unit above them."""
    m1 = publish(_m1(spark, sf_dir), "meanings")
    return _attached(spark, sf_dir, m1, T.units(m1))


@query(f"with {UNITS} select word, meaning_id, row_number() over (partition by word order by tree_id, ord) - 1 as ord from u where word is not null")
def tre_03(spark, sf_dir):
    """Homonyms' trees in one numbering."""
    return T.merge_homonyms(T.units(_m1(spark, sf_dir)))


@query(f"{ATT}, c as (select att.unit_id, string_agg(m1.text, ' ◊ ' order by att.meaning_id) as q from att join m1 using (meaning_id) group by 1) select tree_id, string_agg(text || case when q is null then '' else ' ◊ ' || q end, ' | ' order by ord) as text from u left join c on c.unit_id = u.meaning_id group by tree_id")
def scl_32(spark, sf_dir):
    """Trees as text."""
    m1 = publish(_m1(spark, sf_dir), "meanings")
    u = publish(T.units(m1), "units")
    c = _attached(spark, sf_dir, m1, u).join(m1.select("meaning_id", "text"), "meaning_id")
    return T.render(u, c)


def _latest(spark, sf_dir):
    return last_per_key(read(spark, sf_dir, "meanings"), ["meaning_id"], [F.coalesce("mod_date", F.lit(-1))])


@query()
def jon_20(spark, sf_dir):
    """Articles of one edition from the trees of their entries, or where the chain breaks (an ordered walk:
    no SQL). Stand-ins: a lemma is an entry, linked to the articles of its name and to the trees of its
    name; the links of every seventh tree lead nowhere."""
    d, f = read(spark, sf_dir, "definitions", "form_lemma")
    m = publish(_latest(spark, sf_dir), "meanings")
    d = d.where("word <> ''").select("def_id", "word", "source_id").distinct()
    of = d.groupBy("word").agg(F.sort_array(F.collect_set("source_id")).alias("s"))
    mine = publish(d.where("source_id = 3").select("def_id", "word"), "edition")
    e = mine.join(f.select(F.col("lemma").alias("word")).distinct(), "word", "left_semi").select("def_id", F.col("word").alias("entry_id"))
    te = m.select(F.col("word").alias("entry_id"), F.when(F.col("tree_id") % 7 == 0, -F.col("tree_id")).otherwise(F.col("tree_id")).alias("tree_id")).distinct()
    got = T.definitions_from_trees(mine, e, te, m).join(of, "word")
    return got.select("def_id", X.normalize("word").alias("word"), "status", "definition", F.size("s").alias("n_sources"), F.array_join(F.col("s").cast("array<string>"), ",").alias("source_ids"))


_NORM = "nfc_normalize(translate(lower({}), 'şţ', 'șț'))"


@query(f"""with {M1}, tr as (select tree_id, {_NORM.format("min(word)")} as word from m1 where word is not null group by 1),
sl as (select distinct {_NORM.format("word")} as word from annotations where bookmarked = 1 and word is not null),
kept as (select meaning_id, tr.word, tree_id, type from m1 join tr using (tree_id) where tr.word in (select word from sl)),
rel as (select meaning_id * 2 + k as id, meaning_id, tree_id + 1 + k as target, 1 + meaning_id // (k + 1) % 3 as type from m1, (values (0), (1)) v(k)),
hit as (select meaning_id, string_agg(tr.word, '|' order by rel.id) as synonyms from rel join tr on tr.tree_id = target where rel.type = 1 and tr.word <> '' and meaning_id in (select meaning_id from kept where type = 0) group by 1)
select kept.meaning_id, kept.word, kept.tree_id, kept.type, synonyms from kept left join hit using (meaning_id)""")
def jon_21(spark, sf_dir):
    """Meanings of listed words and the synonyms of their senses. Stand-ins: bookmarked words are the list;
    a meaning has a relation to each of the two next trees, the last of which there aren't."""
    m = publish(_m1(spark, sf_dir), "meanings")
    trees = m.where("word is not null").groupBy("tree_id").agg(F.min("word").alias("word")).withColumn("word", X.normalize("word"))
    short = read(spark, sf_dir, "annotations").where("bookmarked = 1").select(X.normalize("word").alias("word")).distinct()
    rel = m.select("meaning_id", "tree_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(
        (F.col("meaning_id") * 2 + F.col("k")).alias("id"), "meaning_id", (F.col("tree_id") + 1 + F.col("k")).alias("target_tree"),
        F.expr("1 + (meaning_id div (k + 1)) % 3").alias("type"),
    )
    return Y.tree_synonyms(m, trees, short, rel)


# --- the graph of words: a lemma is a sense, its forms are linked to it -------------------------------

GRAPH = f"""{BASE}, se as (select lemma as word, min(form_id) as sid from form_lemma where lemma is not null group by 1),
ed as (select se.sid, f.form as word, cast(1 + min(f.form_id) % 4 as int) as type, cast(min(f.form_id % 3) as int) as src from form_lemma f join se on se.word = f.lemma where f.form is not null and f.form <> f.lemma group by se.sid, f.form),
bd as (select word, case when o <= 0 then 0 else least(7, length(o || '')) end as band from w),
nb as (select distinct a.word, a.sid, b.word as member from (select sid, word from se) a join (select sid, word from ed where type = 1) b using (sid) where a.word <> b.word union select distinct b.word, a.sid, a.word from (select sid, word from se) a join (select sid, word from ed where type = 1) b using (sid) where a.word <> b.word)
"""


def _graph(spark, sf_dir):
    f = read(spark, sf_dir, "form_lemma").where("lemma is not null")
    se = f.groupBy(F.col("lemma").alias("word")).agg(F.min("form_id").alias("sid"))
    e = f.where("form is not null and form <> lemma").join(se.withColumnRenamed("word", "lemma"), "lemma")
    ed = e.groupBy("sid", F.col("form").alias("word")).agg((1 + F.min("form_id") % 4).cast("int").alias("type"), F.min(F.col("form_id") % 3).cast("int").alias("src"))
    bd = _counts(spark, sf_dir, False).select("word", C.band(F.col("occurrences")).alias("band"))
    return se, ed, bd


@query(f"{GRAPH} select distinct unnest([k, translate(lower(k), 'țșţşăâî', 'tstsaai')]) as key, word from (select word as k, word from se union all select ed.word, se.word from ed join se using (sid))")
def grf_01(spark, sf_dir):
    """Keys under which words are found."""
    se, ed, _ = _graph(spark, sf_dir)
    v = ed.join(se.withColumnRenamed("word", "head"), "sid").select(F.col("word").alias("variant"), F.col("head").alias("word"))
    return Y.aliases(se, v)


@query(f"{GRAPH} select word, sid, member from nb")
def jon_18(spark, sf_dir):
    """Neighbours of all words, both ways."""
    se, ed, _ = _graph(spark, sf_dir)
    return Y.neighbours(se, ed)


@query(f"{GRAPH} select sid, type, word, row_number() over (partition by sid, type order by coalesce(band, 0) desc, word) - 1 as nth from ed left join bd using (word)")
def win_06(spark, sf_dir):
    """Places of a sense's members."""
    _, ed, bd = _graph(spark, sf_dir)
    return Y.edge_ranks(ed, bd)


@query(f"{GRAPH}, near as (select nb.*, coalesce(band, 0) as band from nb left join bd on bd.word = nb.member), z as (select word, sid, count(*) as size, max(band) as top from near group by 1, 2) select word, sid, member from (select near.*, row_number() over (partition by near.word, member order by size desc, top desc, sid) as k from near join z using (word, sid)) where k = 1")
def win_10(spark, sf_dir):
    """Each neighbour in the richest of its senses."""
    se, ed, bd = _graph(spark, sf_dir)
    return Y.claim(Y.neighbours(se, ed), bd)


@query(f"""{GRAPH}, near as (select nb.*, coalesce(band, 0) as band from nb left join bd on bd.word = nb.member), z as (select word, sid, count(*) as size, max(band) as top from near group by 1, 2),
k as (select near.word, near.sid, member, band from (select near.*, row_number() over (partition by near.word, member order by size desc, top desc, sid) as k from near join z using (word, sid)) near where k = 1),
t as (select word, sid, max(band) as top from k group by 1, 2), p as (select word, sid, row_number() over (partition by word order by top desc, sid) as sense_place from t)
select word, sid, member, sense_place, row_number() over (partition by word, sid order by band desc, member) as member_place from k join p using (word, sid)""")
def grf_07(spark, sf_dir):
    """The senses of all words: each neighbour in the richest of its senses, senses by their highest band,
    members by band."""
    se, ed, bd = _graph(spark, sf_dir)
    return Y.ordered_senses(Y.claim(Y.neighbours(se, ed), bd), bd)


_RING = """
near as (select nb.*, coalesce(band, 0) as band from nb left join bd on bd.word = nb.member), z as (select word, sid, count(*) as size, max(band) as top from near group by 1, 2),
cl as (select word, sid, member, band from (select near.*, row_number() over (partition by near.word, member order by size desc, top desc, sid) as k from near join z using (word, sid)) where k = 1),
centre as (select word from nb group by word order by count(*) desc, word limit 1),
f as (select *, row_number() over (partition by sid order by band desc, member) as nth, count(*) over (partition by sid) as n, max(band) over (partition by sid) as top from cl where word = (select word from centre)),
so as (select sid, row_number() over (order by n desc, top desc, sid) as place from (select distinct sid, n, top from f)),
r1 as (select row_number() over (order by place, nth) as i, member from f join so using (sid) where place <= 4 and nth <= 6 order by place, nth limit 12),
n2 as (select r1.i, r1.member as parent, c.member, row_number() over (partition by r1.i order by c.band desc, c.member) as nth from r1 join cl c on c.word = r1.member
  where c.member not in (select member from r1) and c.member <> (select word from centre)),
cut as (select i, parent, member, nth from n2 where nth <= 28),
fold(i, nth, used, ring, got) as (
  select 0, 0, []::varchar[], []::varchar[], 0
  union all
  select x.i, x.nth, case when x.take then list_append(used, x.member) else used end, case when x.take then list_append(ring, x.parent || chr(9) || x.member) else ring end, x.got + cast(x.take as int)
  from (select c.i, c.nth, c.parent, c.member, used, ring, case when c.i = fold.i then got else 0 end as got,
          (case when c.i = fold.i then got else 0 end) < 4 and len(ring) < 24 and not list_contains(used, c.member) as take
        from fold join (select *, row_number() over (order by i, nth) as k from cut) c on c.k = coalesce((select k from (select *, row_number() over (order by i, nth) as k from cut) d where d.i = fold.i and d.nth = fold.nth), 0) + 1) x)
"""


@query(f"{GRAPH.replace('with ', 'with recursive ', 1) if 'recursive' not in GRAPH else GRAPH}, {_RING} select 1 as ring, (select word from centre) as parent, member as word from r1 union all select 2, split_part(x, chr(9), 1), split_part(x, chr(9), 2) from (select unnest(ring) as x from fold where len(ring) = (select max(len(ring)) from fold) order by i desc, nth desc limit 1000) group by all", "grf_08")
def win_11(spark, sf_dir):
    """Two capped rings around the word with the most neighbours."""
    se, ed, bd = (publish(x, "graph") for x in _graph(spark, sf_dir))
    top = Y.neighbours(se, ed).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(1).first()
    got = Y.neighbourhood(se, ed, bd, top["word"]) if top else []
    return spark.createDataFrame(got, "ring int, parent string, word string")


@query("select sid, word, type, min(src) as src from (select def_id as sid, word, cast(source_id % 4 as int) as type, cast(user_id % 3 as int) as src from definitions where word is not null) group by 1, 2, 3")
def grf_04(spark, sf_dir):
    """Each edge once, of the first source that has it."""
    e = read(spark, sf_dir, "definitions").where("word is not null").select(F.col("def_id").alias("sid"), "word", (F.col("source_id") % 4).cast("int").alias("type"), (F.col("user_id") % 3).cast("int").alias("src"))
    return Y.merge_sources(e)


def _scraped(spark, sf_dir):
    se, ed, _ = _graph(spark, sf_dir)
    se, ed = publish(se, "senses"), publish(ed, "edges")
    v = ed.join(se.withColumnRenamed("word", "head"), "sid").select(F.col("word").alias("variant"), F.col("head").alias("word"))
    d = read(spark, sf_dir, "definitions").select("def_id", "source_id", "word", "definition").distinct()
    listed = F.translate("definition", ".;!?", ",,,,")
    rows = d.select(F.col("def_id").alias("pos"), "word", F.when(F.col("source_id") % 4 != 0, listed).alias("synonyms"), F.when(F.col("source_id") % 4 == 0, listed).alias("antonyms"))
    have = F.col("sid") % 2 == 0
    return Y.merge_scrape(se.select("word", F.col("sid").alias("word_id")), Y.aliases(se, v), se.where(have), ed.where(have), rows, 1_000_000_000)


@query()
def grf_02(spark, sf_dir):
    """Edges after lists of synonyms and antonyms were merged into the graph (depends on the order of rows:
    no SQL). Stand-ins: articles are the lists, cut at marks; every other lemma has a sense."""
    return _scraped(spark, sf_dir)[2]


@query()
def grf_02_senses(spark, sf_dir):
    """The senses that `grf_02` makes."""
    return _scraped(spark, sf_dir)[1]


@query("with g as (select distinct 2000000000 + source_id as sid, word from definitions where word is not null and source_id is not null) select sid, word, 1 as type, 2 as src from g where sid in (select sid from g group by sid having count(*) > 1)")
def grf_03(spark, sf_dir):
    """Groups as senses of their own."""
    g = read(spark, sf_dir, "definitions").where("word is not null and source_id is not null").select(F.col("source_id").cast("long").alias("group_id"), "word")
    none = spark.createDataFrame([], "sid long, word string, type int")
    return Y.cliques(g, none, 2_000_000_000)[1]


@query("with tw as (select distinct tree_id, word from meanings where word is not null), rel as (select distinct meaning_id as sid, tree_id as source_tree, tree_id + 1 as target_tree, cast(1 + type % 4 as int) as type from meanings) select distinct sid, tw.word, type from rel join tw on tw.tree_id = target_tree where source_tree in (select tree_id from tw)")
def jon_16(spark, sf_dir):
    """Edges of relations between trees."""
    m = read(spark, sf_dir, "meanings")
    tw = m.where("word is not null").select("tree_id", "word").distinct()
    rel = m.select(F.col("meaning_id").alias("sid"), F.col("tree_id").alias("source_tree"), (F.col("tree_id") + 1).alias("target_tree"), (1 + F.col("type") % 4).cast("int").alias("type")).distinct()
    return Y.relation_edges(rel, tw)


@query("""with tw as (select distinct tree_id, word from meanings where word is not null),
te as (select tree_id, word as entry, 0 as r from tw union all select tree_id - 1, word, 1 from tw where tree_id % 2 = 1),
x as (select te.tree_id, f.form as word, r, entry, form_id, row_number() over (partition by te.tree_id, f.form order by r, entry, form_id) as k
  from te join form_lemma f on f.lemma = te.entry where form_id % 3 <> 2 and f.form <> '')
select tree_id, word, row_number() over (partition by tree_id order by r, entry, form_id, word) - 1 as position from x where k = 1""")
def jon_15(spark, sf_dir):
    """The words of trees in order. Stand-ins: a lemma is an entry, its forms the lexemes, two of three of
    them main; a tree has the entry of its word, and one with an even number that of the next tree too."""
    m, f = read(spark, sf_dir, "meanings", "form_lemma")
    tw = m.where("word is not null").select("tree_id", F.col("word").alias("entry_id")).distinct()
    te = tw.withColumn("entry_rank", F.lit(0)).unionByName(tw.where("tree_id % 2 = 1").select((F.col("tree_id") - 1).alias("tree_id"), "entry_id", F.lit(1).alias("entry_rank")))
    el = f.select(F.col("lemma").alias("entry_id"), F.col("form").alias("word"), F.col("form_id").alias("lexeme_rank"), (F.col("form_id") % 3 != 2).cast("int").alias("main"))
    return Y.expand_trees(te, el)


def _tree_graph(spark, sf_dir):
    """Words of trees, entries and relations as in `jon_15` and `jon_16`."""
    m, f = read(spark, sf_dir, "meanings", "form_lemma")
    tw = m.where("word is not null").select("tree_id", F.col("word").alias("entry_id")).distinct()
    te = tw.unionByName(tw.where("tree_id % 2 = 1").select((F.col("tree_id") - 1).alias("tree_id"), "entry_id"))
    x = publish(jon_15(spark, sf_dir).select("tree_id", "word"), "tree-words")
    rel = m.select("tree_id", (F.col("tree_id") + 1).alias("target"), (1 + F.col("type") % 4).alias("type")).distinct()
    to = x.select(F.col("tree_id").alias("target"), F.col("word").alias("b"))
    links = publish(rel.join(x.withColumnRenamed("word", "a"), "tree_id").join(to, "target").select("a", "b", "type").distinct(), "links")
    return Y.tree_pairs(x, te, links.where("type = 1 and a <> b")), links.select(F.explode(F.array("a", "b")).alias("word"))


_PAIRS = """with tw as (select distinct tree_id, word from meanings where word is not null),
te as (select tree_id, word as entry from tw union select tree_id - 1, word from tw where tree_id % 2 = 1),
x as (select distinct te.tree_id, f.form as word from te join form_lemma f on f.lemma = te.entry where form_id % 3 <> 2 and f.form <> ''),
lk as (select distinct s.word as a, t.word as b, r.type from (select distinct tree_id, 1 + type % 4 as type from meanings where type is not null) r join x s using (tree_id) join x t on t.tree_id = r.tree_id + 1),
l1 as (select distinct least(a, b) as a, greatest(a, b) as b from lk where type = 1 and a <> b),
pr as (select p.tree_id, p.word as a, q.word as b from x p join x q on p.tree_id = q.tree_id and p.word < q.word
  where p.tree_id in (select tree_id from te group by 1 having count(distinct entry) > 1) and not exists (select 1 from l1 where l1.a = p.word and l1.b = q.word))"""


@query(f"{_PAIRS} select tree_id, a, b from pr")
def jon_17(spark, sf_dir):
    """Pairs of words of one tree that aren't linked yet."""
    return _tree_graph(spark, sf_dir)[0]


@query(f"""{_PAIRS}, he as (select a as word from lk union select b from lk), m as (select tree_id, a as word from pr union select tree_id, b from pr)
select 2000000000 + tree_id as sid, m.word, 5 as type, 2 as src, cast(he.word is null as int) as gains from m left join he using (word)""")
def grf_03_trees(spark, sf_dir):
    """Trees as senses of their own: words with an unlinked mate, and which gain a first edge."""
    return Y.tree_cliques(*_tree_graph(spark, sf_dir), 2_000_000_000)


@query(f"{GRAPH} select se.word, coalesce(band, 0) as band from se left join bd using (word) where starts_with(translate(lower(se.word), 'țșţşăâî', 'tstsaai'), 'st') order by 2 desc, 1 limit 8", "jon_19")
def grf_06(spark, sf_dir):
    """Words that a beginning suggests."""
    se, _, bd = _graph(spark, sf_dir)
    n = se.join(bd, "word", "left").select("word", F.coalesce("band", F.lit(0)).alias("band"), X.fold("word").alias("key"))
    return E.autocomplete(n, "ST")


@query(f"{GRAPH}, n as (select se.word, coalesce(band, 0) as band, translate(lower(se.word), 'țșţşăâî', 'tstsaai') as key from se left join bd using (word)), h as (select word, band, min(case when key = 'st' then 1 when starts_with(key, 'st') then 2 when contains(key, 'st') then 3 end) as tier from n where contains(key, 'st') group by 1, 2) select word, band, tier from h where tier = (select min(tier) from h) order by word = 'St' desc, band desc, word limit 8")
def grf_05(spark, sf_dir):
    """What a query may mean: exact, else by beginning, else by a part."""
    se, _, bd = _graph(spark, sf_dir)
    n = se.join(bd, "word", "left").select("word", F.coalesce("band", F.lit(0)).alias("band"), X.fold("word").alias("key"))
    return E.resolve(n, "St")


# --- streams and states ------------------------------------------------------------------------------


SKIP, LIMIT = 20, 60


@query(f"with d as (select * from (select *, row_number() over (order by doc_id) as k from (select distinct on (doc_id) doc_id, text from documents order by doc_id, text)) where k > {SKIP} and k <= {SKIP + LIMIT}), t as (select doc_id, unnest(list_filter(regexp_extract_all(translate(lower(text), 'şţ', 'șț'), '[a-zăâîșț](?:[a-zăâîșț\\-'']*[a-zăâîșț])?'), lambda w: length(w) >= 3)) as word from d) select word, count(*) as occurrences, count(distinct doc_id) as documents from t group by word")
def src_11(spark, sf_dir):
    """A count that goes on after the first documents and stops after so many: skip and limit of a run."""
    d = first_per_key(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], ["text"])
    return C.count_words(files.skip_and_limit(d, ["doc_id"], SKIP, LIMIT))


@query(f"with t as (select doc_id, unnest(list_filter(regexp_extract_all(translate(lower(text), 'şţ', 'șț'), '[a-zăâîșț](?:[a-zăâîșț\\-'']*[a-zăâîșț])?'), lambda w: length(w) >= 3)) as word from documents) select word, count(*) as occurrences, count(distinct doc_id) as documents from t group by word")
def str_01(spark, sf_dir):
    """Counts of a stream of documents, batch by batch."""
    return jobs.count_stream(jobs.source(spark, sf_dir, "documents"))[0]


@query(f"select user_id, word, seq, deleted from {STATE}", "snk_07")
def str_02(spark, sf_dir):
    """The state after a stream of changes."""
    return jobs.change_stream(jobs.source(spark, sf_dir, "annotations")).select("user_id", "word", "seq", "deleted")


@query(f"select user_id, word, seq, deleted from {STATE} where word in (select word from definitions)")
def str_02_known(spark, sf_dir):
    """The same, changes of unknown words rejected."""
    known = read(spark, sf_dir, "definitions").select("word").where("word is not null").distinct()
    return jobs.change_stream(jobs.source(spark, sf_dir, "annotations"), known=known).select("user_id", "word", "seq", "deleted")


@query(f"""with server as {STATE}, own as (select * exclude (k) from server where seq % 2 = 0 and deleted = 0),
l as (select user_id, word, case when seq % 4 = 0 then updated_at + interval 1 hour else updated_at - interval 1 hour end as at, 'local' as origin from own)
select coalesce(l.user_id, s.user_id) as user_id, coalesce(l.word, s.word) as word, case when l.at >= s.updated_at then 'local' else 'remote' end as origin
from l full join server s on l.user_id = s.user_id and l.word = s.word where l.at >= s.updated_at or s.deleted = 0""")
def str_03(spark, sf_dir):
    """A client's marks after the server's changes. Stand-ins: the client holds every other live mark, half of
    them edited an hour later than the server knows, half an hour earlier."""
    s = publish(apply_changes(read(spark, sf_dir, "annotations")).withColumn("origin", F.lit("remote")), "server")
    hour = F.expr("interval 1 hour")
    own = s.where("seq % 2 = 0 and deleted = 0").withColumn("origin", F.lit("local"))
    own = own.withColumn("updated_at", F.when(F.col("seq") % 4 == 0, F.col("updated_at") + hour).otherwise(F.col("updated_at") - hour))
    return M.apply_remote(own, s, ["user_id", "word"], "updated_at", ["origin"]).select("user_id", "word", "origin")


@query(f"""with s as (select word, updated_at from {STATE} where user_id = (select min(user_id) from annotations) and deleted = 0), t as (select word, updated_at from {STATE} where user_id = (select max(user_id) from annotations))
select coalesce(s.word, t.word) as word, case when s.word is null then 'keep' when t.word is null then 'insert' when s.updated_at > t.updated_at then 'update' else 'keep' end as action from s full join t on s.word = t.word""")
def str_04(spark, sf_dir):
    """What merging one user's marks into another's does."""
    s = apply_changes(read(spark, sf_dir, "annotations"))
    r = s.agg(F.min("user_id").alias("a"), F.max("user_id").alias("b")).first()
    one = lambda u: s.where(F.col("user_id") == u).select("word", "updated_at", "deleted")
    return M.merge_states(one(r["a"]), one(r["b"]), "word", "updated_at").select("word", "action")


@query(f"{STREAKS} select \"user\" as user_id, answers, correct, best, current from s where mode = 'all'")
def str_05(spark, sf_dir):
    """Runs of right answers kept as state of a stream."""
    return jobs.streak_stream(_answers(jobs.source(spark, sf_dir, "events")))


@query("select user_id, min(ts) is not null as used from events where user_id is not null group by user_id")
def str_06(spark, sf_dir):
    """Tokens that were used, each once."""
    e = jobs.source(spark, sf_dir, "events").where("user_id is not null").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return jobs.first_uses(e, "user_id", "at", "100000 hours").select("user_id", F.lit(True).alias("used"))


@query("select user_id, strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as start, count(*) as n from events where ts is not null group by 1, 2")
def str_07(spark, sf_dir):
    """Events by user and hour, as a stream."""
    e = jobs.source(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at")).where("at is not null")
    return jobs.window_counts(e, "user_id", "at", "1 hour").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("select event_id, cast(row_number() over (partition by user_id, epoch(ts)::bigint // 3600 order by ts, event_id) <= 2 as int) as allowed from events")
def str_07_limit(spark, sf_dir):
    """Events within a limit of two an hour."""
    return M.rate_limited(read(spark, sf_dir, "events"), "user_id", "ts", 3600, 2, "event_id").select("event_id", "allowed")


@query("select event_id, state from (select *, lag(state) over (partition by user_id order by ts, event_id) as p from (select *, case when value < 5 then 'low' when value < 50 then 'mid' else 'high' end as state from events)) where state is distinct from p")
def str_08(spark, sf_dir):
    """Only changes of state."""
    v = F.col("value")
    return M.state_changes(read(spark, sf_dir, "events"), "user_id", "ts", F.when(v < 5, "low").when(v < 50, "mid").otherwise("high"), "event_id").select("event_id", "state")


@query("""with i as (select user_id as list, word, row_number() over (partition by user_id order by min(seq), word) - 1 as position from annotations where word is not null and deleted = 0 group by 1, 2),
w as (select distinct user_id as list, word from annotations where word is not null and bookmarked = 1), t as (select list, max(position) as top from i group by 1), n as (select list, word, row_number() over (partition by list order by word) as k from (select * from w except select list, word from i))
select list, word, cast(position as int) as position from i semi join w using (list, word) where position < 1000 union all select n.list, word, cast(coalesce(top, -1) + k as int) from n left join t using (list) where k <= 1000 and coalesce(top, -1) + k < 1000""")
def str_09(spark, sf_dir):
    """A list brought up to date: words that left go, new ones come last."""
    a = read(spark, sf_dir, "annotations").where("word is not null").withColumnRenamed("user_id", "list")
    i = a.where("deleted = 0").groupBy("list", "word").agg(F.min("seq").alias("s"))
    i = publish(global_rank(i, ["s", "word"], "position", ["list"]).select("list", "word", (F.col("position") - 1).alias("position")), "items")
    return M.refresh_list(i, a.where("bookmarked = 1").select("list", "word").distinct())


@query("select user_id, word, min(seq) as seq from annotations where word is not null group by 1, 2")
def str_10(spark, sf_dir):
    """One report per user and word, the first."""
    a = read(spark, sf_dir, "annotations").where("word is not null").select("user_id", "word", "seq")
    return first_per_key(a, ["user_id", "word"], ["seq"])


# --- request shapes ----------------------------------------------------------------------------------


@query(f"with {UNITS} select meaning_id, ord, text from (select word, meaning_id, text, row_number() over (partition by word order by tree_id, ord) - 1 as ord from u where word is not null) where word = (select min(word) from u where word is not null)")
def api_word(spark, sf_dir):
    """One word with its senses in order."""
    u = publish(T.units(_m1(spark, sf_dir)), "units")
    w = u.agg(F.min("word").alias("w")).first()["w"]
    one = u.where(F.col("word") == w)
    return T.merge_homonyms(one).join(one.select("meaning_id", "text"), "meaning_id").select("meaning_id", "ord", "text")


@query("with a as (select distinct on (seq) seq, word, deleted from annotations where user_id = (select mode(user_id) from annotations) and word is not null order by seq, word, deleted), p as (select * from a where seq > 10 order by seq limit 500) select seq, word, deleted, cast((select count(*) from a where seq > 10) > 500 as int) as has_more from p")
def api_sync(spark, sf_dir):
    """One page of a user's changes after a cursor, and whether there are more."""
    a = read(spark, sf_dir, "annotations")
    me = a.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").first()["user_id"]
    mine = first_per_key(a.where((F.col("user_id") == me) & (F.col("seq") > 10) & F.col("word").isNotNull()).select("seq", "word", "deleted"), ["seq"], ["word", "deleted"])
    got = publish(mine.orderBy("seq").limit(501), "page")
    more = int(got.count() > 500)
    return got.orderBy("seq").limit(500).withColumn("has_more", F.lit(more))


@query("select text as etymon, count(*) as n from (select distinct meaning_id, text from meanings where type = 1 and text <> '') group by text")
def tre_04(spark, sf_dir):
    """Etymologies and how often each is given."""
    m = read(spark, sf_dir, "meanings").where("type = 1 and text <> ''").select("meaning_id", "text").distinct()
    return m.groupBy(F.col("text").alias("etymon")).agg(F.count("*").alias("n"))


@query("select word, label, in_table from (select distinct a.word, label, cast(d.word is not null as int) as in_table from (select word, unnest(tags) as label from annotations where word is not null) a left join (select distinct word from definitions) d using (word)) where in_table = 0")
def jon_24(spark, sf_dir):
    """Labels whose words aren't in the serving table."""
    a, d = read(spark, sf_dir, "annotations", "definitions")
    lab = a.where("word is not null").select("word", F.explode("tags").alias("label")).distinct()
    return lab.join(d.select("word"), "word", "left_anti").withColumn("in_table", F.lit(0))
