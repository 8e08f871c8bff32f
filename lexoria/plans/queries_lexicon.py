"""Counting, rolling up, ranking and classifying words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.functions import text as X
from lexoria.operators import community as M, corpus as C
from lexoria.operators.keyed import distinct_in_order, first_per_key, last_per_key, lookup_two_tier, preferred_per_key
from lexoria.operators.rank import global_rank, new_numbers, percentile_ranks
from lexoria.plans.runtime import broadcast_within, publish, read

QUERIES, ORACLES = {}, {}
#: Bytes of tags up to which they are broadcast.
TAG_BYTES = 8 << 20
HIST, MODERN = ["romane_vechi", "gazete_1900"], ["web_azi", "subtitrari"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _counts(spark: SparkSession, sf_dir: str, by_corpus: bool = True) -> DataFrame:
    c = read(spark, sf_dir, "corpus_word_frequency").where("word is not null and corpus_name is not null").dropDuplicates(["id"])
    keys = ["corpus_name", "word"] if by_corpus else ["word"]
    return c.groupBy(*keys).agg(F.sum(F.coalesce("occurrence_count", F.lit(0))).alias("occurrences"), F.sum(F.coalesce("document_count", F.lit(0))).alias("documents"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.form_map(read(spark, sf_dir, "form_lemma"))


# SQL for the same: c(corpus_name, word, o, d), w(word, o, d), fl(form, lemma)
BASE = """
with recursive x as (select distinct on (id) * from corpus_word_frequency where word is not null and corpus_name is not null),
c as (select corpus_name, word, cast(sum(coalesce(occurrence_count, 0)) as bigint) as o, cast(sum(coalesce(document_count, 0)) as bigint) as d from x group by 1, 2),
w as (select word, cast(sum(o) as bigint) as o, cast(sum(d) as bigint) as d from c group by 1),
fl as (select distinct form, lemma from form_lemma where form is not null and lemma is not null),
sh as (select c.corpus_name, c.word as form, coalesce(fl.lemma, c.word) as lemma, c.o, c.d, coalesce(h.o, 0) + 1 as wt
       from c left join fl on fl.form = c.word left join c h on h.corpus_name = c.corpus_name and h.word = coalesce(fl.lemma, c.word)),
st as (select *, cast(wt as double) / sum(wt) over (partition by corpus_name, form) as s from sh),
strict as (select corpus_name, lemma, cast(round_even(round(sum(o * s), 6), 0) as bigint) as o, cast(round_even(round(max(d * s), 6), 0) as bigint) as d from st group by 1, 2),
hist as (select lemma, cast(sum(o) as bigint) as o, cast(sum(d) as bigint) as d from strict where corpus_name in ('romane_vechi', 'gazete_1900') group by 1),
modern as (select lemma, cast(sum(o) as bigint) as o, cast(sum(d) as bigint) as d from strict where corpus_name in ('web_azi', 'subtitrari') group by 1),
hr as (select lemma, row_number() over (order by o, lemma) / cast(count(*) over () as double) as p from hist where o > 0),
mr as (select lemma, row_number() over (order by o, lemma) / cast(count(*) over () as double) as p from modern where o > 0),
uni as (select lemma from hist union select lemma from modern),
dia as (select uni.lemma, coalesce(hist.o, 0) as ho, coalesce(hist.d, 0) as hd, coalesce(modern.o, 0) as mo, coalesce(modern.d, 0) as md, coalesce(hr.p, 0) - coalesce(mr.p, 0) as shift
        from uni left join hist using (lemma) left join modern using (lemma) left join hr using (lemma) left join mr using (lemma))
"""
TOK = "list_filter(regexp_extract_all(translate(lower(text), 'şţ', 'șț'), '[a-zăâîșț](?:[a-zăâîșț\\-'']*[a-zăâîșț])?'), lambda w: length(w) >= 3)"
DOCS = f"with d as (select * from documents), t as (select doc_id, source, author, lang, unnest({TOK}) as word from d)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "source", "author", "lang")


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vocabulary(read(spark, sf_dir, "form_lemma"), "form", F.length("form") > 2)


VOCAB = "v as (select distinct nfc_normalize(translate(lower(trim(form, ' ')), 'şţ', 'șț')) as word from form_lemma where length(form) > 2)"


@query(f"select distinct nfc_normalize(translate(lower(trim(form, ' ')), 'şţ', 'șț')) as word from form_lemma where length(form) > 2 and trim(form, ' ') <> ''")
def flt_01(spark, sf_dir):
    """The lookup vocabulary of counting."""
    return _vocab(spark, sf_dir)


@query(f"{DOCS}, {VOCAB} select word, count(*) as occurrences, count(distinct doc_id) as documents from t semi join v using (word) group by word")
def agg_01(spark, sf_dir):
    """Occurrences and documents of every vocabulary word."""
    return C.count_words(_docs(spark, sf_dir), vocabulary=_vocab(spark, sf_dir))


QUERIES["jon_01"], ORACLES["jon_01"] = agg_01, ORACLES["agg_01"]


@query(f"{DOCS} select word, count(*) as occurrences, count(distinct coalesce(author, '__' || doc_id)) as documents from t group by word")
def agg_02(spark, sf_dir):
    """The unit is the author; a document without one is its own."""
    return C.count_words(_docs(spark, sf_dir), F.coalesce("author", F.concat(F.lit("__"), F.col("doc_id").cast("string"))))


@query(f"{DOCS} select coalesce(lang, '?') as lang, word, count(*) as occurrences, count(distinct source) + max(case when source is null then 1 else 0 end) as documents from t group by 1, 2")
def agg_03(spark, sf_dir):
    """The unit is the source, counted within each language."""
    return C.count_words(_docs(spark, sf_dir).withColumn("lang", F.coalesce("lang", F.lit("?"))), F.col("source"), by=["lang"])


@query(f"{BASE} select corpus_name, lemma, o as occurrences, d as documents from strict")
def agg_04(spark, sf_dir):
    """Counts of forms shared out to lemmas."""
    return C.roll_up(_counts(spark, sf_dir), _claims(spark, sf_dir), ["corpus_name"])


@query(f"{BASE} select corpus_name, lemma, cast(sum(o) as bigint) as occurrences from sh group by 1, 2")
def agg_05(spark, sf_dir):
    """Counts of forms given in full to every lemma that claims them."""
    return C.roll_up_loose(_counts(spark, sf_dir), _claims(spark, sf_dir), ["corpus_name"])


@query(f"{BASE} select lemma, o as occurrences, d as documents from hist")
def agg_06(spark, sf_dir):
    """A panel: the sum of corpora that were each rolled up."""
    return C.merge_panel(C.roll_up(_counts(spark, sf_dir), _claims(spark, sf_dir), ["corpus_name"]), HIST)


@query(f"{BASE} select word, cast(sum(o) as bigint) as occurrences, cast(sum(d) as bigint) as documents from c where corpus_name in ('web_azi', 'subtitrari') group by word")
def agg_07(spark, sf_dir):
    """A panel of citation forms."""
    return C.merge_panel(_counts(spark, sf_dir), MODERN, "word")


COVER = """
(select word, count(distinct source_id) as dict_count, string_agg(distinct cast(source_id as varchar), '|' order by cast(source_id as varchar)) as sources,
  cast(min(year(to_timestamp(mod_date) at time zone 'UTC')) as int) as oldest, cast(max(year(to_timestamp(mod_date) at time zone 'UTC')) as int) as newest
 from definitions where word is not null group by word)"""


def _cover(spark, sf_dir):
    d = read(spark, sf_dir, "definitions").where("word is not null")
    year = F.year(F.timestamp_seconds("mod_date"))
    return d.groupBy("word").agg(
        F.count_distinct("source_id").alias("dict_count"),
        F.array_join(F.sort_array(F.collect_set(F.col("source_id").cast("string"))), "|").alias("sources"),
        F.min(year).alias("oldest"), F.max(year).alias("newest"),
    )


@query(f"select word, dict_count, sources, oldest, newest, cast(newest >= 2015 as int) as in_current from {COVER}")
def agg_08(spark, sf_dir):
    """In how many dictionaries a word is, which, and of what years."""
    return _cover(spark, sf_dir).withColumn("in_current", (F.col("newest") >= 2015).cast("int"))


OBJ = "(select distinct m.meaning_id, m.word, t.id as tag_id, t.parentId, t.value, t.isPos from (select distinct meaning_id, word, type from meanings where word is not null) m join (select distinct on (id) * from tag order by id, modDate desc) t on t.id = 100 + m.meaning_id % 600)"


def _tags(spark, sf_dir):
    t = last_per_key(read(spark, sf_dir, "tag").select("id", "parentId", "value", "isPos", "modDate"), ["id"], ["modDate"])
    return t


def _object_tags(spark, sf_dir):
    """Tags of senses: a stand-in for the table that links them."""
    m = read(spark, sf_dir, "meanings").where("word is not null").select("meaning_id", "word").distinct()
    t = _tags(spark, sf_dir).select(F.col("id").alias("tag_id"), "parentId", "value", "isPos")
    return m.join(broadcast_within(t, TAG_BYTES), F.lit(100) + m["meaning_id"] % 600 == t["tag_id"])


FAMILY = "case when isPos = 1 then 'pos' when coalesce(parentId, 0) % 3 = 0 then 'register' when parentId % 3 = 1 then 'domain' else 'etymology' end"


def _family():
    p = F.coalesce("parentId", F.lit(0)) % 3
    return F.when(F.col("isPos") == 1, "pos").when(p == 0, "register").when(p == 1, "domain").otherwise("etymology")


@query(f"select word, {FAMILY} as family, string_agg(distinct value, '|' order by value) as names from {OBJ} where value is not null group by 1, 2")
def agg_09(spark, sf_dir):
    """The tags of a word in four families, word class before family."""
    o = _object_tags(spark, sf_dir)
    return o.where("value is not null").groupBy("word", _family().alias("family")).agg(F.array_join(F.sort_array(F.collect_set("value")), "|").alias("names"))


@query("select word, string_agg(text, '|' order by first_id) as texts from (select word, text, min(meaning_id) as first_id from meanings where type = 1 and text <> '' and word is not null group by 1, 2) group by word")
def agg_10(spark, sf_dir):
    """Etymologies of a word, each once, in the order of their first appearance."""
    m = read(spark, sf_dir, "meanings").where("type = 1 and text <> '' and word is not null").groupBy("word", "text").agg(F.min("meaning_id").alias("i"))
    return m.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "|").alias("texts"))


PARTS = "(select trim(unnest(string_split_regex(definition, '[.;,] '))) as part from (select distinct on (def_id) * from definitions where definition is not null))"


@query(f"select part, count(*) as n from {PARTS} where part <> '' group by part")
def agg_11(spark, sf_dir):
    """How often each value of a multi-valued column occurs."""
    d = read(spark, sf_dir, "definitions").where("definition is not null").select("def_id", "definition").distinct()
    return d.select(F.explode(X.split_clean("definition", "[.;,] ")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("""
with d as (select distinct def_id, word, definition, source_id, user_id from definitions)
select 'total' as facet, '' as value, count(*) as n from d
union all select 'with_def', '', count(definition) from d
union all (select 'source', source_id || '', count(*) as n from d where source_id is not null group by source_id order by n desc, source_id || '' limit 15)
union all (select 'user', user_id || '', count(*) as n from d where user_id is not null group by user_id order by n desc, user_id || '' limit 10)""")
def agg_12(spark, sf_dir):
    """Facets: totals and the most frequent values of several columns, in one scan each."""
    d = publish(read(spark, sf_dir, "definitions").select("def_id", "word", "definition", "source_id", "user_id").distinct(), "facets")
    one = d.agg(F.count("*").alias("total"), F.count("definition").alias("with_def")).unpivot([], ["total", "with_def"], "facet", "n").select("facet", F.lit("").alias("value"), "n")
    facet = lambda c, k: d.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k).select(F.lit(c.split("_")[0]).alias("facet"), "value", "n")
    return one.unionByName(facet("source_id", 15)).unionByName(facet("user_id", 10))


@query(f"{BASE} select case when mo >= 200 then case when shift <= -0.15 then 'emerging' else 'alive' end when not (ho >= 3 and hd >= 2) then 'absent' when mo = 0 then 'extinct' when mo < 20 then 'historical_only' else 'declining' end as verdict, count(*) as n from dia group by 1")
def agg_16(spark, sf_dir):
    """Words by verdict."""
    return cls_03(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


@query("select form, lemma, count(*) over (partition by form) as n_lemmas from (select distinct form, lemma from form_lemma where form is not null and lemma is not null)")
def agg_18(spark, sf_dir):
    """How many lemmas claim a form."""
    return _claims(spark, sf_dir)


@query(f"{BASE} select lemma, cast(sum(o) as bigint) as occurrences, case when sum(o) <= 0 then 0 else least(7, length(cast(sum(o) as bigint) || '')) end as band from (select coalesce(fl.lemma, w.word) as lemma, w.o from w left join fl on fl.form = w.word) where lemma in (select word from definitions) group by lemma")
def agg_19(spark, sf_dir):
    """Bands of frequency of the lemmas that are headwords."""
    loose = C.roll_up_loose(_counts(spark, sf_dir, False), _claims(spark, sf_dir))
    heads = read(spark, sf_dir, "definitions").select(F.col("word").alias("lemma")).distinct()
    return loose.join(heads, "lemma", "left_semi").withColumn("band", C.band(F.col("occurrences")))


@query(f"{BASE} select fl.lemma, cast(sum(c.o) as bigint) as occurrences from c join fl on fl.form = c.word where corpus_name in ('web_azi', 'subtitrari') group by 1")
def agg_20(spark, sf_dir):
    """Modern counts of whole paradigms."""
    m = _counts(spark, sf_dir).where(F.col("corpus_name").isin(MODERN)).withColumnRenamed("word", "form")
    return m.join(_claims(spark, sf_dir).select("form", "lemma"), "form").groupBy("lemma").agg(F.sum("occurrences").alias("occurrences"))


@query(f"{BASE} select fl.lemma, round(max(log10(w.o / (select sum(o) from w) * 1e9)), 6) as zipf from w join fl on fl.form = w.word where w.o > 0 group by 1")
def agg_21(spark, sf_dir):
    """The highest Zipf frequency in a paradigm."""
    w = _counts(spark, sf_dir, False).withColumnRenamed("word", "form")
    total = w.agg(F.sum("occurrences").alias("t")).first()["t"] or 0
    z = w.join(_claims(spark, sf_dir).select("form", "lemma"), "form").withColumn("z", C.zipf(F.col("occurrences"), F.lit(total)))
    return z.where("z is not null").groupBy("lemma").agg(F.round(F.max("z"), 6).alias("zipf"))


@query(f"""{BASE}, q as (select corpus_name, count(distinct word) as words, cast(sum(o) as bigint) as tokens, max(d) as top, sum(case when o <= 0 then 1 else 0 end) as bad from c group by 1),
r as (select *, case when corpus_name like 'w%' then top - 1 else greatest(top, tokens // 100) end as docs, corpus_name <> 'carti_scanate' as done from q)
select corpus_name, 'no_cycling' as check_name, case when docs > 0 and top > docs then 'fail' else 'pass' end as verdict from r
union all select corpus_name, 'positive_counts', case when bad > 0 then 'fail' else 'pass' end from r
union all select corpus_name, 'token_ratio', case when docs > 0 and tokens > 0 then case when tokens / docs < 50 or tokens / docs > 2000 then 'warn' else 'pass' end else 'skip' end from r
union all select corpus_name, 'word_coverage', case when not done then 'skip' when words < 5000 then 'fail' else 'pass' end from r
union all select '', 'all_complete', case when exists (select 1 from (values ('romane_vechi'), ('carti_scanate')) e(n) where n not in (select corpus_name from r where done)) then 'warn' else 'pass' end""")
def agg_22(spark, sf_dir):
    """Checks of corpora's counts against their runs. Stand-ins: a run has as many documents as its most
    frequent word, or a hundredth of its tokens if that is more, one too few in corpora of the web; one
    corpus isn't completed."""
    c = publish(_counts(spark, sf_dir), "counts")
    q = c.groupBy("corpus_name").agg(F.sum("occurrences").alias("tokens"), F.max("documents").alias("top"))
    docs = F.when(F.col("corpus_name").startswith("w"), F.col("top") - 1).otherwise(F.greatest("top", F.floor(F.col("tokens") / 100)))
    runs = q.select("corpus_name", docs.alias("docs"), "tokens", F.when(F.col("corpus_name") != "carti_scanate", "completed").otherwise("started").alias("status"))
    return C.quality_checks(c, runs, ["romane_vechi", "carti_scanate"])


@query("""with d as (select distinct doc_id, coalesce(source, '?') as source, coalesce(lang, '?') as lang from documents)
select source, count(*) filter (lang = 'ro') as ro, count(*) filter (lang = 'en') as en, count(*) filter (lang not in ('ro', 'en')) as other,
 round(100.0::double * count(*) filter (lang = 'ro') / count(*), 1) as ro_pct from d group by source""")
def agg_23(spark, sf_dir):
    """A pivot of strata and labels with shares."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("?")).alias("source"), F.when(F.col("lang").isin("ro", "en"), F.col("lang")).otherwise("other").alias("label")).distinct()
    p = d.groupBy("source").pivot("label", ["ro", "en", "other"]).agg(F.count(F.lit(1))).fillna(0)
    return p.withColumn("ro_pct", F.round(F.lit(100.0) * F.col("ro") / (F.col("ro") + F.col("en") + F.col("other")), 1))


@query("select cast(year // 10 * 10 as int) as decade, count(*) as n from (select distinct doc_id, year from documents) group by 1")
def agg_24(spark, sf_dir):
    """Documents by decade."""
    d = read(spark, sf_dir, "documents").select("doc_id", "year").distinct()
    return d.groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


@query(f"{BASE} select case when o < 5 then '0-4' when o < 50 then '5-49' when o < 500 then '50-499' else '500+' end as bucket, count(*) as n from w group by 1")
def agg_25(spark, sf_dir):
    """Buckets of frequency."""
    o = F.col("occurrences")
    return _counts(spark, sf_dir, False).groupBy(F.when(o < 5, "0-4").when(o < 50, "5-49").when(o < 500, "50-499").otherwise("500+").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"{BASE} select word, cast(sum(o) as bigint) as occurrences, count(*) as corpora from c group by word order by 2 desc, word limit 20")
def agg_26(spark, sf_dir):
    """The 20 most frequent words over all corpora."""
    return _counts(spark, sf_dir).groupBy("word").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("corpora")).orderBy(F.desc("occurrences"), "word").limit(20)


@query(f"{BASE} select case when o <= 0 then 0 else least(7, length(o || '')) end as band, count(*) as n, round(100.0::double * count(dw.word) / count(*), 3) as covered_pct from w left join (select distinct word from definitions) dw using (word) group by 1")
def agg_27(spark, sf_dir):
    """Bands of frequency and what share of each is in the dictionary."""
    w = _counts(spark, sf_dir, False).withColumn("band", C.band(F.col("occurrences")))
    heads = read(spark, sf_dir, "definitions").where("word is not null").select("word").distinct().withColumn("in_dict", F.lit(1))
    return w.join(heads, "word", "left").groupBy("band").agg(F.count("*").alias("n"), F.round(F.lit(100.0) * F.count("in_dict") / F.count("*"), 3).alias("covered_pct"))


@query("select coalesce(lang, '?') as stratum, count(distinct doc_id) as total, count(distinct case when title is not null then doc_id end) as labelled from documents group by 1")
def agg_28(spark, sf_dir):
    """Progress of labelling by stratum."""
    d = read(spark, sf_dir, "documents").groupBy("doc_id", F.coalesce("lang", F.lit("?")).alias("stratum")).agg(F.max(F.col("title").isNotNull()).alias("l"))
    return d.groupBy("stratum").agg(F.count("*").alias("total"), F.count_if("l").alias("labelled"))


@query("""with m as (select distinct meaning_id, word, type, text from meanings where word is not null), w as (select word, count(*) filter (type = 0 and coalesce(text, '') <> '') as senses, count(*) filter (type = 2) as citations from m group by word)
select count(*) as words, count(*) filter (senses >= 2) as several, cast(sum(senses) as bigint) as senses, cast(sum(citations) as bigint) as citations from w""")
def agg_29(spark, sf_dir):
    """Statistics of senses and words."""
    m = read(spark, sf_dir, "meanings").where("word is not null").select("meaning_id", "word", "type", "text").distinct()
    w = m.groupBy("word").agg(F.count_if((F.col("type") == 0) & (F.coalesce("text", F.lit("")) != "")).alias("senses"), F.count_if(F.col("type") == 2).alias("citations"))
    return w.agg(F.count("*").alias("words"), F.count_if(F.col("senses") >= 2).alias("several"), F.sum("senses").alias("senses"), F.sum("citations").alias("citations"))


# --- ranks -------------------------------------------------------------------------------------------


@query(f"{BASE} select lemma, round(p, 9) as pct from hr")
def win_01(spark, sf_dir):
    """Places of lemmas in the historical panel, as shares; ties are broken by the word."""
    return percentile_ranks(agg_06(spark, sf_dir), "occurrences", "lemma").select("lemma", F.round("pct", 9).alias("pct"))


def _diachronic(spark, sf_dir):
    strict = publish(C.roll_up(_counts(spark, sf_dir), _claims(spark, sf_dir), ["corpus_name"]), "strict")
    h, m = (publish(C.merge_panel(strict, p), "panel") for p in (HIST, MODERN))
    hr, mr = (percentile_ranks(x, "occurrences", "lemma", n).select("lemma", n) for x, n in ((h, "hp"), (m, "mp")))
    h, m = h.toDF("lemma", "hist", "hist_docs"), m.toDF("lemma", "modern", "modern_docs")
    zero = F.lit(0).cast("long")
    both = h.join(m, "lemma", "full").join(hr, "lemma", "left").join(mr, "lemma", "left")
    return both.select(
        "lemma", *[F.coalesce(c, zero).alias(c) for c in ("hist", "hist_docs", "modern", "modern_docs")],
        (F.coalesce("hp", F.lit(0.0)) - F.coalesce("mp", F.lit(0.0))).alias("shift"),
    )


@query(f"{BASE} select lemma, round(shift, 9) as shift from dia")
def win_02(spark, sf_dir):
    """How much a lemma's place differs between the panels."""
    return _diachronic(spark, sf_dir).select("lemma", F.round("shift", 9).alias("shift"))


_VERDICT = "case when mo >= 200 then case when shift <= -0.15 then 'emerging' else 'alive' end when not (ho >= 3 and hd >= 2) then 'absent' when mo = 0 then 'extinct' when mo < 20 then 'historical_only' else 'declining' end"


@query(f"{BASE} select lemma, ho as hist, hd as hist_docs, mo as modern, md as modern_docs, {_VERDICT} as verdict from dia")
def cls_03(spark, sf_dir):
    """The verdict on each lemma."""
    d = _diachronic(spark, sf_dir)
    v = C.verdict(F.col("hist"), F.col("hist_docs"), F.col("modern"), F.col("shift"), rare=20, alive=200)
    return d.select("lemma", "hist", "hist_docs", "modern", "modern_docs", v.alias("verdict"))


@query(f"{BASE}, k as (select lemma, cast(sum(o) as bigint) as loose from (select coalesce(fl.lemma, w.word) as lemma, w.o from w left join fl on fl.form = w.word) group by 1), s as (select lemma, cast(sum(o) as bigint) as o from strict group by 1) select dia.lemma, round(log2((ho + 0.1::double) / (mo + 0.1::double)), 6) as log_ratio, round(ho * 1e6 / (select sum(o) from hist), 6) as hist_ppm, round(case when s.o > 0 then k.loose / s.o else 1.0 end, 6) as family from dia join k using (lemma) join s using (lemma)")
def cls_05(spark, sf_dir):
    """Rates, the logarithm of their ratio, and loose to strict counts."""
    d = publish(_diachronic(spark, sf_dir), "dia")
    total = d.agg(F.sum("hist").alias("t")).first()["t"] or 0
    loose = C.roll_up_loose(_counts(spark, sf_dir, False), _claims(spark, sf_dir)).withColumnRenamed("occurrences", "loose")
    strict = C.roll_up(_counts(spark, sf_dir), _claims(spark, sf_dir), ["corpus_name"]).groupBy("lemma").agg(F.sum("occurrences").alias("strict"))
    j = d.join(loose, "lemma").join(strict, "lemma")
    r = lambda c: F.round(c, 6)
    return j.select("lemma", r(C.log_ratio(F.col("hist"), F.col("modern"))).alias("log_ratio"), r(C.per_million(F.col("hist"), F.lit(total))).alias("hist_ppm"), r(C.family_ratio(F.col("strict"), F.col("loose"))).alias("family"))


@query("select word, min(def_id) as def_id from definitions where word is not null and coalesce(definition, '') <> '' group by word")
def win_03(spark, sf_dir):
    """The first definition of a word: the lowest id."""
    d = read(spark, sf_dir, "definitions").where("word is not null and coalesce(definition, '') <> ''").select("word", "def_id")
    return first_per_key(d, ["word"], ["def_id"])


@query("select word, arg_min(def_id, (case when source_id = 1 then 0 else 1 end) * 1000000000 + def_id) as def_id from definitions where word is not null group by word")
def win_04(spark, sf_dir):
    """A preferred source beats the others, else the first."""
    d = read(spark, sf_dir, "definitions").where("word is not null").select("word", "def_id", "source_id")
    return preferred_per_key(d, ["word"], F.coalesce(F.col("source_id") == 1, F.lit(False)), ["def_id"]).select("word", "def_id")


@query("""with r as (select distinct on (id) id, corpus_name, coalesce(document_count, 0) as docs, last_updated as t, id % 3 <> 0 as done from corpus_word_frequency where corpus_name is not null),
b as (select corpus_name, id, docs, row_number() over (partition by corpus_name order by docs desc, t desc nulls last, id) as k from r where done)
select corpus_name, max(r.id) as newest_id, max(b.id) as best_id, max(b.docs) as best_docs from r left join b using (corpus_name) where coalesce(b.k, 1) = 1 group by corpus_name""")
def win_05(spark, sf_dir):
    """The run of each corpus that counts: of the completed ones that with the most documents, then the
    latest; and the newest run of all. Stand-ins: counts are runs, two of three of them completed."""
    c = read(spark, sf_dir, "corpus_word_frequency").where("corpus_name is not null").dropDuplicates(["id"])
    r = c.select("corpus_name", "id", F.coalesce("document_count", F.lit(0)).alias("docs"), F.col("last_updated").cast("timestamp").alias("at"), F.when(F.col("id") % 3 != 0, "completed").otherwise("started").alias("status"))
    r = publish(r, "runs")
    best = C.best_runs(r).select("corpus_name", F.col("id").alias("best_id"), F.col("docs").alias("best_docs"))
    return r.groupBy("corpus_name").agg(F.max("id").alias("newest_id")).join(best, "corpus_name", "left")


@query("select word, meaning_id, row_number() over (partition by word order by meaning_id) - 1 as ord from (select distinct word, meaning_id from meanings where word is not null)")
def win_07(spark, sf_dir):
    """The ordinal of a sense within its word."""
    m = read(spark, sf_dir, "meanings").where("word is not null").select("word", "meaning_id").distinct()
    return global_rank(m, ["meaning_id"], "ord", within=["word"]).withColumn("ord", F.col("ord") - 1)


@query("""with w as (select word, min(id) as k from corpus_word_frequency where word is not null group by word), a as (select distinct word from annotations where word is not null),
n as (select word, row_number() over (order by word) as r from (select word from a where word not in (select word from w)))
select word as name, k as number from w union all select word, (select max(k) from w) + r from n""")
def win_13(spark, sf_dir):
    """Permanent numbers of words: known ones stay, unseen ones get the next in order of the alphabet."""
    c, a = read(spark, sf_dir, "corpus_word_frequency", "annotations")
    known = c.where("word is not null").groupBy(F.col("word").alias("name")).agg(F.min("id").alias("number"))
    return new_numbers(known, a.select(F.col("word").alias("name")))


@query("""with i as (select user_id as list, word, row_number() over (partition by user_id order by min(seq), word) as position from annotations where word is not null and user_id is not null and deleted = 0 group by 1, 2),
w as (select *, row_number() over (partition by list order by word) as place from (select distinct user_id as list, word from annotations where word is not null and user_id is not null and bookmarked = 1)),
t as (select list, max(position) as top from i semi join (select * from w where place <= 1000) using (list, word) group by 1)
select w.list, w.word, coalesce(i.position, coalesce(top, 0) + place) as position from w left join i using (list, word) left join t on t.list = w.list where place <= 1000""")
def win_12(spark, sf_dir):
    """Lists filled from bookmarks: what stays keeps its position, new words come after the highest one.
    Stand-ins: a user's live words are the list, in the order of their sequence."""
    a = read(spark, sf_dir, "annotations").where("word is not null and user_id is not null").withColumnRenamed("user_id", "list")
    i = global_rank(a.where("deleted = 0").groupBy("list", "word").agg(F.min("seq").alias("s")), ["s", "word"], "position", ["list"]).select("list", "word", "position")
    w = global_rank(a.where("bookmarked = 1").select("list", "word").distinct(), ["word"], "place", ["list"])
    return M.fill_list(publish(i, "items"), publish(w, "wanted"))


@query("select lemma, arg_min(form, (case when form = lemma then 0 else 1 end) * 1000000000 + form_id) as form from form_lemma where lemma is not null and form is not null group by lemma")
def win_14(spark, sf_dir):
    """Of a lemma's rows that with the lemma itself, else the first."""
    f = read(spark, sf_dir, "form_lemma").where("lemma is not null and form is not null").select("lemma", "form", "form_id")
    return preferred_per_key(f, ["lemma"], F.col("form") == F.col("lemma"), ["form_id"]).select("lemma", "form")


@query("select head, min(def_id) as def_id from (select nfc_normalize(translate(lower(word), 'şţ', 'șț')) as head, def_id from definitions where word is not null) group by head")
def win_15(spark, sf_dir):
    """The first row of each normalized headword."""
    d = read(spark, sf_dir, "definitions").where("word is not null").select(X.normalize("word").alias("head"), "def_id")
    return first_per_key(d, ["head"], ["def_id"])


# --- joins -------------------------------------------------------------------------------------------


@query(f"select distinct meaning_id, word, value from {OBJ} where parentId > 0 or isPos = 1")
def jon_02(spark, sf_dir):
    """The chain from senses to tags, with the tags that matter."""
    o = _object_tags(spark, sf_dir)
    return o.where((F.col("parentId") > 0) | (F.col("isPos") == 1)).select("meaning_id", "word", "value").distinct()


@query(f"select distinct word, value from {OBJ} where word in (select word from definitions) union select d.word, t.value from (select distinct def_id, word from definitions where word is not null) d join (select distinct on (id) * from tag order by id, modDate desc) t on t.id = 100 + d.def_id % 600")
def jon_03(spark, sf_dir):
    """Tags of headwords by two paths: by sense and direct."""
    d = read(spark, sf_dir, "definitions").where("word is not null").select("def_id", "word").distinct()
    by_sense = _object_tags(spark, sf_dir).join(d.select("word").distinct(), "word", "left_semi").select("word", "value")
    direct = d.join(broadcast_within(_tags(spark, sf_dir), TAG_BYTES), F.lit(100) + F.col("def_id") % 600 == F.col("id")).select("word", "value")
    return by_sense.unionByName(direct).distinct()


@query("select f.form, f.lemma, min(d.def_id) as def_id from (select distinct form, lemma from form_lemma) f join definitions d on d.word = f.lemma group by 1, 2")
def jon_04(spark, sf_dir):
    """Forms with the headwords of their lemmas, one row per pair."""
    f, d = read(spark, sf_dir, "form_lemma", "definitions")
    heads = d.groupBy(F.col("word").alias("lemma")).agg(F.min("def_id").alias("def_id"))
    return f.select("form", "lemma").distinct().join(heads, "lemma").select("form", "lemma", "def_id")


@query("select distinct def_id, word, cast(word in (select word from annotations where word is not null and deleted = 0) as int) as marked from definitions where word is not null")
def jon_05(spark, sf_dir):
    """Words that are marked and words that aren't: a semi and an anti join."""
    d, a = read(spark, sf_dir, "definitions", "annotations")
    d, a = d.where("word is not null").select("def_id", "word").distinct(), a.where("deleted = 0 and word is not null").select("word").distinct()
    return d.join(a, "word", "left_semi").withColumn("marked", F.lit(1)).unionByName(d.join(a, "word", "left_anti").withColumn("marked", F.lit(0)))


@query("select d.def_id, coalesce(v.n, 0) as votes from (select distinct def_id, word from definitions) d left join (select word, count(*) as n from annotations where bookmarked = 1 group by word) v using (word)")
def jon_06(spark, sf_dir):
    """All words, with votes where there are any."""
    d, a = read(spark, sf_dir, "definitions", "annotations")
    v = a.where("bookmarked = 1").groupBy("word").agg(F.count("*").alias("n"))
    return d.select("def_id", "word").distinct().join(v, "word", "left").select("def_id", F.coalesce("n", F.lit(0)).alias("votes"))


@query("select d.word, d.n_defs, v.n as marks from (select word, count(distinct def_id) as n_defs from definitions group by word) d join (select word, count(*) as n from annotations group by word) v using (word)")
def jon_07(spark, sf_dir):
    """Only words with marks."""
    d, a = read(spark, sf_dir, "definitions", "annotations")
    dd = d.select("word", "def_id").distinct().groupBy("word").agg(F.count("*").alias("n_defs"))
    return dd.join(a.groupBy("word").agg(F.count("*").alias("marks")), "word")


@query("select a.user_id, a.word, a.seq, coalesce(d.def_id, 0) as def_id from (select distinct user_id, word, min(seq) over (partition by user_id, word) as seq from annotations where word is not null) a left join (select word, min(def_id) as def_id from definitions group by word) d using (word)")
def jon_08(spark, sf_dir):
    """The items of a list, in order; words that are gone get an empty row."""
    a, d = read(spark, sf_dir, "annotations", "definitions")
    items = distinct_in_order(a.where("word is not null").select("user_id", "word", "seq"), ["user_id", "word"], "seq")
    return items.join(d.groupBy("word").agg(F.min("def_id").alias("def_id")), "word", "left").select("user_id", "word", "seq", F.coalesce("def_id", F.lit(0)).alias("def_id"))


@query("select d.def_id, d.user_id, u.n as edits from (select distinct def_id, user_id from definitions) d join (select user_id, count(*) as n from (select distinct def_id, user_id from definitions) group by 1) u using (user_id)")
def jon_09(spark, sf_dir):
    """Rows with their owner's data."""
    d = read(spark, sf_dir, "definitions").select("def_id", "user_id").distinct()
    return d.join(d.groupBy("user_id").agg(F.count("*").alias("edits")), "user_id")


@query("select user_id, count(*) as n from (select distinct user_id, seq from annotations where deleted = 0) group by user_id having count(*) > 5")
def jon_10(spark, sf_dir):
    """Users with more than a few marks."""
    a = read(spark, sf_dir, "annotations").where("deleted = 0").select("user_id", "seq").distinct()
    return a.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 5")


@query("""select coalesce(l.label, '_unlabeled') as label, count(*) as n from (select distinct word from definitions where word is not null) d
left join (select distinct word, unnest(tags) as label from annotations where word is not null) l using (word) group by 1""")
def jon_11(spark, sf_dir):
    """Words by label, with a bucket for those without."""
    d, a = read(spark, sf_dir, "definitions", "annotations")
    lab = a.where("word is not null").select("word", F.explode("tags").alias("label")).distinct()
    return d.where("word is not null").select("word").distinct().join(lab, "word", "left").groupBy(F.coalesce("label", F.lit("_unlabeled")).alias("label")).agg(F.count("*").alias("n"))


@query(f"""with k as (select word, min(def_id) as v from definitions where word is not null group by word), f as (select translate(lower(word), 'țșţşăâî', 'tstsaai') as g, count(*) as n, min(v) as v from k group by 1)
select form_id, coalesce(k.v, f.v) as def_id from (select distinct form_id, form from form_lemma) x left join k on k.word = x.form left join f on f.g = translate(lower(x.form), 'țșţşăâî', 'tstsaai') and f.n = 1""")
def jon_12(spark, sf_dir):
    """Exact headword, else the one that folds alike if it is the only one."""
    f, d = read(spark, sf_dir, "form_lemma", "definitions")
    k = d.where("word is not null").groupBy("word").agg(F.min("def_id").alias("def_id"))
    return lookup_two_tier(f.select("form_id", "form").distinct(), "form", k, "word", X.fold, ["def_id"]).select("form_id", "def_id")


@query(f"""select d.word, c.dict_count, coalesce(w.o, 0) as occurrences, coalesce(s.n, 0) as senses from (select distinct word from definitions where word is not null) d join {COVER} c using (word)
left join (select word, cast(sum(occurrence_count) as bigint) as o from (select distinct on (id) * from corpus_word_frequency) group by word) w using (word) left join (select word, count(distinct meaning_id) as n from meanings where type = 0 group by word) s using (word)""")
def jon_13(spark, sf_dir):
    """Headwords enriched from several tables in turn."""
    cover = _cover(spark, sf_dir).select("word", "dict_count")
    c, m = read(spark, sf_dir, "corpus_word_frequency", "meanings")
    w = c.dropDuplicates(["id"]).groupBy("word").agg(F.sum("occurrence_count").alias("o"))
    s = m.where("type = 0").select("word", "meaning_id").distinct().groupBy("word").agg(F.count("*").alias("n"))
    return cover.join(w, "word", "left").join(s, "word", "left").select("word", "dict_count", F.coalesce("o", F.lit(0)).alias("occurrences"), F.coalesce("n", F.lit(0)).alias("senses"))


@query(f"""{BASE}, n as (select form, count(*) as k from fl group by form having count(*) > 1), p as (select distinct a.lemma, b.lemma as other from fl a join n using (form) join fl b using (form) where a.lemma <> b.lemma)
select lemma, other from (select p.*, row_number() over (partition by p.lemma order by coalesce(w.o, 0) desc, other) as r from p left join w on w.word = p.other) where r = 1""")
def jon_14(spark, sf_dir):
    """The most frequent other lemma with which a lemma shares a form."""
    return C.co_claimants(_claims(spark, sf_dir), _counts(spark, sf_dir, False))


@query("select count(*) as orphans from (select distinct form_id, lemma from form_lemma) f where lemma is null or lemma not in (select word from definitions where word is not null)")
def jon_22(spark, sf_dir):
    """Forms whose lemma is no headword."""
    f, d = read(spark, sf_dir, "form_lemma", "definitions")
    return f.select("form_id", "lemma").distinct().join(d.select(F.col("word").alias("lemma")), "lemma", "left_anti").agg(F.count("*").alias("orphans"))


@query(f"{BASE} select word, o as occurrences, least(cast(o as double) / 100, 1.0) as freq, case when least(cast(o as double) / 100, 1.0) <= 0.01 then null when least(cast(o as double) / 100, 1.0) < 0.3 then 'very_rare' when least(cast(o as double) / 100, 1.0) < 0.5 then 'rare' when least(cast(o as double) / 100, 1.0) < 0.6 then 'uncommon' else 'standard' end as bin, case when least(cast(o as double) / 100, 1.0) < 0.3 then 'very_rare' when least(cast(o as double) / 100, 1.0) < 0.5 then 'rare' else 'uncommon' end as bin2 from w")
def cls_01(spark, sf_dir):
    """Bins of rarity, by both rules."""
    f = F.least(F.col("occurrences").cast("double") / 100, F.lit(1.0))
    return _counts(spark, sf_dir, False).select("word", "occurrences", f.alias("freq"), C.rarity(f).alias("bin"), C.rarity_of_candidates(f).alias("bin2"))


QUERIES["cls_02"], ORACLES["cls_02"] = cls_01, ORACLES["cls_01"]


@query(f"{BASE} select word, case when o <= 0 then 0 else least(7, length(o || '')) end as band, case when o = 0 then 0 when o < 50 then 1 else 2 end as modern_band, case when o < 10 then 5 when o < 100 then 12 when o < 1000 then 20 else 30 end as points from w")
def cls_16(spark, sf_dir):
    """Bands and ladders of points."""
    o = F.col("occurrences")
    return _counts(spark, sf_dir, False).select("word", C.band(o).alias("band"), C.modern_band(o, 50).alias("modern_band"), C.banded(o, [(10, 5), (100, 12), (1000, 20)], 30).alias("points"))


QUERIES["cls_13"], ORACLES["cls_13"] = cls_16, ORACLES["cls_16"]


@query(f"{BASE}, t as (select corpus_name, cast(sum(o) as bigint) as tokens from c group by 1) select corpus_name, tokens, cast(round_even(500.0::double * tokens / 16969999321, 0) as bigint) as rare_bar, cast(round_even(2000.0::double * tokens / 16969999321, 0) as bigint) as alive_bar from t")
def cls_04(spark, sf_dir):
    """Thresholds scaled to the size of a corpus."""
    t = _counts(spark, sf_dir).groupBy("corpus_name").agg(F.sum("occurrences").alias("tokens"))
    bar = lambda b: F.bround(F.lit(float(b)) * F.col("tokens") / F.lit(C.CALIBRATED)).cast("long")
    return t.select("corpus_name", "tokens", bar(500).alias("rare_bar"), bar(2000).alias("alive_bar"))


@query(f"{BASE} select word, round(log10(o / (select sum(o) from w) * 1e9), 6) as zipf from w where o > 0")
def udf_04(spark, sf_dir):
    """Zipf frequencies from our own counts."""
    w = _counts(spark, sf_dir, False).where("occurrences > 0")
    total = w.agg(F.sum("occurrences").alias("t")).first()["t"] or 0
    return w.select("word", F.round(C.zipf(F.col("occurrences"), F.lit(total)), 6).alias("zipf"))


@query("select d.def_id, coalesce(l.lemma, d.word) as lemma from (select distinct def_id, word from definitions where word is not null) d left join (select form, min(lemma) as lemma from form_lemma where form is not null and lemma is not null group by form) l on l.form = d.word")
def udf_03(spark, sf_dir):
    """A lemmatizer that is a table: the form's first lemma, else the word itself."""
    d, f = read(spark, sf_dir, "definitions", "form_lemma")
    lem = f.where("form is not null and lemma is not null").groupBy(F.col("form").alias("word")).agg(F.min("lemma").alias("lemma"))
    return d.where("word is not null").select("def_id", "word").distinct().join(lem, "word", "left").select("def_id", F.coalesce("lemma", "word").alias("lemma"))
