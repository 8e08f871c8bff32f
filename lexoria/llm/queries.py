"""Queries of the llm operators and the SQL that gives the same results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.llm.leaks import find_leaks
from lexoria.llm.neardup import EVERY, copies, groups, near_duplicates
from lexoria.llm.packing import pack
from lexoria.llm.quality import LIMITS, common_list, flag, learn, statistics
from lexoria.llm.spelling import clean_rows
from lexoria.llm.terms import mark_terms, marked_terms, term_totals
from lexoria.plans.runtime import publish, read


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = read(spark, sf_dir, "definitions", "meanings")
    return d.select(F.lit("definitions").alias("space"), F.col("def_id").alias("id"), F.col("definition").alias("text")).unionByName(
        m.select(F.lit("meanings").alias("space"), F.col("meaning_id").alias("id"), "text")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles, and of sense texts, that share at least 0.7 of their words; all pairs of copies too."""
    return near_duplicates(_articles(spark, sf_dir), expand=EVERY).withColumnRenamed("space", "table_name")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each article and sense text, and its number of mates."""
    return groups(_articles(spark, sf_dir)).withColumnRenamed("space", "table_name")


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and sense texts that stand more than once: each with the first of its copies and their number."""
    return copies(_articles(spark, sf_dir)).withColumnRenamed("space", "table_name")


#: Columns of the table of counts: the word, its counts and the row's key.
COUNTED = ("word", "occurrence_count", "document_count", "id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are too rare or too common."""
    return marked_terms(read(spark, sf_dir, "corpus_word_frequency"), *COUNTED).select(F.col("term").alias("word"), "mark")


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of every word."""
    return mark_terms(term_totals(read(spark, sf_dir, "corpus_word_frequency"), *COUNTED)).select(F.col("term").alias("word"), "occurrences", "documents", F.col("rows").alias("n_rows"), F.coalesce("mark", F.lit("")).alias("mark"))


SPELLED = (("corpus_word_frequency", "id", "word"), ("form_lemma", "form_id", "form"), ("definitions", "def_id", "word"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose headword or form isn't in its consistent spelling, with that spelling."""
    out = None
    for table, key, text in SPELLED:
        got = clean_rows(read(spark, sf_dir, table), key, text, changed_only=True).dropDuplicates(["key"])
        got = got.select(F.lit(table).alias("table_name"), F.col("key").alias("row_id"), "clean")
        out = got if out is None else out.unionByName(got)
    return out


#: Token ranks by which documents are measured; another public file may be named instead.
TOKENIZER = os.environ.get("LEXORIA_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
CAPACITY = 2048


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of 2,048 tokens that each document, or each piece of a longer one, is in."""
    return pack(read(spark, sf_dir, "documents"), TOKENIZER, CAPACITY)


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for `p6_pack`, in one row: documents laid, rows over capacity, documents whose pieces
    aren't all full but the last, numbers of rows left out, and whether under 0.5 % of the rows could be saved."""
    laid = publish(p6_pack(spark, sf_dir), "laid")
    docs = laid.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_distinct("piece").alias("d"), F.max("piece").alias("last"),
        F.count_if((F.col("n_tokens") < CAPACITY)).alias("part_full"), F.count_if(F.col("start") != F.col("piece") * CAPACITY).alias("shifted"),
        F.min(F.struct("n_tokens", "piece")).alias("least"),
    )
    bad = (F.col("n") != F.col("d")) | (F.col("last") + 1 != F.col("n")) | (F.col("part_full") > 1) | (F.col("shifted") > 0)
    bad = bad | ((F.col("part_full") == 1) & (F.col("least.piece") != F.col("last")))
    of_docs = docs.agg(F.count("*").alias("n_docs"), F.count_if(bad).alias("bad_docs"))
    rows = laid.groupBy("row_id").agg(F.sum("n_tokens").alias("n"))
    of_rows = rows.agg(
        F.count_if(F.col("n") > CAPACITY).alias("over_rows"), (F.max("row_id") + 1 - F.count("*")).alias("missing_rows"),
        (F.count("*") <= 1.005 * F.ceil(F.sum("n") / CAPACITY) + 1).alias("tight"),
    )
    return of_docs.join(of_rows, F.lit(True)).select("n_docs", "over_rows", "bad_docs", "missing_rows", F.col("tight").cast("int").alias("tight"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the held-out items of which they hold 12 or more consecutive words."""
    docs, items = read(spark, sf_dir, "documents", "eval_items")
    return find_leaks(docs, items)


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, common = read(spark, sf_dir, "documents", "common_words")
    return statistics(docs, common_list(common, "word"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the statistics of theirs that are out of range."""
    stats = _statistics(spark, sf_dir)
    return flag(stats, learn(stats)).distinct()


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document."""
    return _statistics(spark, sf_dir).select("doc_id", *LIMITS).distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p2_copies, p4_found, p4_totals, p5_found, p6_pack, p6_invariants, p7_found, p8_found, p8_stats)}

_PAIRS = """
t as (
  select 'definitions' as table_name, def_id as id, definition as text from definitions where definition is not null
  union select 'meanings', meaning_id, text from meanings where text is not null),
s as (select table_name, id, list_distinct(regexp_extract_all(lower(text), '\\p{L}+')) as words from t),
w as (select table_name, id, len(words) as n, unnest(words) as word from s where len(words) >= 12),
seldom as (select word, count(*) as df from w group by word),
r as (select w.*, row_number() over (partition by table_name, id order by df, word) as k from w join seldom using (word)),
c as (select distinct a.table_name, a.id as id_a, b.id as id_b from r a join r b on a.table_name = b.table_name and a.word = b.word and a.id < b.id
      where a.k <= a.n - ceil(0.7 * a.n) + 1 and b.k <= b.n - ceil(0.7 * b.n) + 1),
pairs as (select c.table_name, c.id_a, c.id_b from c
join s x on x.table_name = c.table_name and x.id = c.id_a join s y on y.table_name = c.table_name and y.id = c.id_b
where len(list_intersect(x.words, y.words)) >= 0.7 * (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))))"""

_SUMS = """
(select word, cast(sum(coalesce(occurrence_count, 0)) as bigint) as occurrences, cast(sum(coalesce(document_count, 0)) as bigint) as documents,
   count(*) as n_rows from (select distinct on (id) * from corpus_word_frequency) where word is not null group by word)
"""
_MARK = "case when occurrences < 5 or documents < 3 then 'rare' when documents > 100000 then 'common' else '' end"

_STATS = r"""
with d as (select distinct doc_id, text from documents),
p as (select doc_id, length(text) as chars, regexp_extract_all(lower(text), '\p{L}+') as w,
        length(regexp_replace(text, '[\p{L}\p{Nd}\s]', '', 'g')) as sym,
        list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') as l from d),
s as (select doc_id, cast(len(w) as double) as words,
        case when len(w) > 0 then length(array_to_string(w, '')) / len(w) end as word_len,
        case when chars > 0 then sym / chars end as symbols,
        case when len(l) > 0 then len(list_filter(l, lambda x: right(x, 1) in ('.', '!', '?', '…', ';', ':', '"', '”', '»'))) / len(l) end as line_end,
        case when len(w) > 0 then len(list_filter(w, lambda x: list_contains(c.words, x))) / len(w) end as common
      from p, (select list(lower(word)) as words from common_words) c)
"""

def _clean_sql() -> str:
    """The consistent spelling in SQL. Its look-alikes are written out here, apart from those of the operator."""
    wide = "".join(chr(k) for k in range(0xFF01, 0xFF5F))
    plain = "".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F))
    q = lambda s: "'" + s.replace("'", "''") + "'"
    # Cyrillic, Greek and other letters that look Latin, and those Latin letters below them
    like = "асеһіјӏорԛѕѵԝхуԁАВСЕНІЈКМОРԚЅТѴԜХУӀαινορυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿɑɡı"
    latin = "acehijlopqsvwxydABCEHIJKMOPQSTVWXYIaivopucjABEZHIKMNOPTYXCJagi"
    other = "".join(c for c in map(chr, range(0x400, 0x460)) if c not in like)
    return rf"""
with r as (select 'corpus_word_frequency' as table_name, id as row_id, word as s from corpus_word_frequency where word is not null
  union select 'form_lemma', form_id, form from form_lemma where form is not null union select 'definitions', def_id, word from definitions where word is not null),
a as (select *, translate(replace(replace(replace(
    regexp_replace(regexp_replace(s, '[\x{{AD}}\x{{34F}}\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{2064}}\x{{FE00}}-\x{{FE0F}}\x{{FEFF}}]', '', 'g'), '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'),
    'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬆ', 'st'), {q(wide)} || 'ⅰⅴⅹⅼⅽⅾⅿ‐‑‒', {q(plain)} || 'ivxlcdm---') as x from r),
b as (select *, array_to_string(list_transform(regexp_extract_all(x, '[^ \-]+|[ \-]'), lambda t:
    case when regexp_full_match(t, '[\p{{Cyrillic}}\p{{M}}]+') and (regexp_matches(t, '[{other}]') or not regexp_matches(x, '\p{{Latin}}')) then t else translate(t, {q(like)}, {q(latin)}) end), '') as y from a),
c as (select *, trim(translate(nfc_normalize(regexp_replace(regexp_replace(y, '([sStT])\x{{327}}', '\1' || chr(806), 'g'), '([aA])\x{{30C}}', '\1' || chr(774), 'g')), 'şŞţŢǎǍ', 'șȘțȚăĂ'), ' ') as clean from b)
select table_name, row_id, clean from c where clean <> s"""


_CLEAN = _clean_sql()

ORACLES = {
    "p2_found": f"with {_PAIRS} select table_name, id_a, id_b from pairs",
    "p2_groups": f"""with recursive {_PAIRS},
both_ways as (select table_name, id_a as a, id_b as b from pairs union all select table_name, id_b, id_a from pairs),
reach as (select table_name, id, id as o from s where len(words) >= 12 union select r.table_name, r.id, p.b from reach r join both_ways p on p.table_name = r.table_name and p.a = r.o)
select r.table_name, r.id, min(r.o) as class_id, count(distinct case when p.b = r.o and y.text <> x.text then y.text end) as links
from reach r join t x on x.table_name = r.table_name and x.id = r.id join t y on y.table_name = r.table_name and y.id = r.o
left join both_ways p on p.table_name = r.table_name and p.a = r.id and p.b = r.o group by r.table_name, r.id""",
    "p2_copies": f"""with {_PAIRS}, same as (select table_name, text, min(id) as rep, count(*) as copies from t join s using (table_name, id) where len(words) >= 12 group by 1, 2)
select t.table_name, t.id, rep, copies from t join same using (table_name, text) where copies > 1""",
    "p4_found": f"select word, {_MARK} as mark from {_SUMS} where {_MARK} <> ''",
    "p4_totals": f"select word, occurrences, documents, n_rows, {_MARK} as mark from {_SUMS}",
    "p6_invariants": """select count(distinct doc_id) as n_docs, cast(0 as bigint) as over_rows, cast(0 as bigint) as bad_docs,
  cast(0 as bigint) as missing_rows, 1 as tight from documents""",
    "p7_found": """
with g as (select id, is_doc, array_to_string(ws[i : i + 11], ' ') as gram from (
  select id, is_doc, ws, unnest(range(1, len(ws) - 10)) as i from (
    select doc_id as id, true as is_doc, regexp_extract_all(strip_accents(lower(text)), '\\p{L}+') as ws from documents where text is not null
    union all select item_id, false, regexp_extract_all(strip_accents(lower(text)), '\\p{L}+') from eval_items)))
select distinct d.id as doc_id, e.id as item_id from g d join g e on d.gram = e.gram where d.is_doc and not e.is_doc""",
    "p8_stats": _STATS + "select doc_id, " + ", ".join(LIMITS) + " from s",
    "p8_found": _STATS
    + """select doc_id, 'words' as stat from s where words < 20
union all select doc_id, 'word_len' from s where word_len < 3.5 or word_len > 7.5
union all select doc_id, 'symbols' from s where symbols > 0.125
union all select doc_id, 'line_end' from s where line_end < 0.5
union all select doc_id, 'common' from s where common < 0.25""",
    "p5_found": _CLEAN,
}
