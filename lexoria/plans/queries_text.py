"""Queries of the text functions, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.functions import codec, text as X
from lexoria.functions.html import best_texts, html_entries
from lexoria.plans.runtime import read

QUERIES, ORACLES = {}, {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def _on(table: str, key: str, **cols):
    """One row per distinct row of (key, outputs)."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        return df.select(key, *[c().alias(n) for n, c in cols.items()]).distinct()

    return build


def _sql(table: str, key: str, **cols) -> str:
    return f"select distinct {key}, {', '.join(f'{c} as {n}' for n, c in cols.items())} from {table}"


def _both(name: str, table: str, key: str, pairs: dict) -> None:
    _add(name, _on(table, key, **{n: a for n, (a, _) in pairs.items()}), _sql(table, key, **{n: b for n, (_, b) in pairs.items()}))


NORM = "translate(lower({}), 'şţ', 'șț')"
FOLD = "translate(lower({}), 'țșţşăâî', 'tstsaai')"
TOKENS = f"list_filter(regexp_extract_all({NORM.format('text')}, '[a-zăâîșț](?:[a-zăâîșț\\-'']*[a-zăâîșț])?'), lambda w: length(w) >= 3)"
_both("scl_01", "definitions", "def_id", {"norm": (lambda: X.normalize("word"), f"nfc_normalize({NORM.format('word')})")})
_both("scl_02", "form_lemma", "form_id", {"folded": (lambda: X.fold("form"), FOLD.format("form"))})
_both("scl_03", "documents", "doc_id", {
    "tokens": (lambda: F.size(X.tokenize("text")), f"cast(len({TOKENS}) as int)"),
    "kinds": (lambda: F.size(F.array_distinct(X.tokenize("text"))), f"cast(len(list_distinct({TOKENS})) as int)"),
})
_both("scl_04", "documents", "doc_id", {
    "tokens": (lambda: F.size(X.tokenize_wide("text")), r"cast(len(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}_''\-]+')) as int)"),
})
_both("scl_05", "documents", "doc_id", {
    "year_named": (lambda: X.latest_year("text"), r"list_max(list_transform(regexp_extract_all(text, '(1[5-9]\d{2}|20\d{2})', 1), lambda y: cast(y as int)))"),
})
RAW = "concat('12@', word, '$  {{sursa: ', word, '}} [345]__', definition, '__ #')"
_NULLIF = r"nullif(trim(regexp_replace(regexp_replace(translate(regexp_replace({}, '\{{\{{[^}}]*\}}\}}', '', 'g'), '@#$%', ''), '^\d+', ''), '\s+', ' ', 'g'), ' '), '')"
_both("scl_06", "definitions", "def_id", {"clean": (lambda: X.clean_markup(F.expr(RAW)), _NULLIF.format(RAW.replace("concat(", "(").replace(", ", " || ").replace("sursa: ' ||", "sursa: ' ||")))})
_both("scl_07", "definitions", "def_id", {"clean": (lambda: X.clean_entry(F.expr(RAW)), _NULLIF.format(r"replace(regexp_replace(" + RAW.replace("concat(", "(").replace(", ", " || ") + r", '\[\d+\]', '', 'g'), '__', '')"))})
_both("scl_08", "definitions", "def_id", {
    "target": (lambda: X.pointer_target(F.expr("concat(' vezi ', word, '. ')")), f"nullif({NORM.format(r'''regexp_extract(' vezi ' || word || '. ', '(?i)^[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]*vezi[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+([^\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000},;.]+)[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]*\.?[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]*$', 1)''')}, '')"),
    "none": (lambda: X.pointer_target("definition"), f"nullif({NORM.format(r'''regexp_extract(definition, '(?i)^[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]*vezi[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+([^\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000},;.]+)[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]*\.?[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]*$', 1)''')}, '')"),
})
# DuckDB measures bytes: the characters of a pair that take several are changed for single ones first
_SINGLE = "translate({}, odd, array_to_string(list_transform(range(1, 32), lambda x: chr(cast(x as int))), ''))"
_add("scl_09", _on("form_lemma", "form_id", distance=lambda: F.levenshtein("form", "lemma")), f"""
select distinct form_id, cast(levenshtein({_SINGLE.format("form")}, {_SINGLE.format("lemma")}) as int) as distance
from (select form_id, form, lemma, array_to_string(list_distinct(regexp_extract_all(form || lemma, '[^\\x00-\\x7F]')), '') as odd from form_lemma)""")
_both("scl_10", "meanings", "meaning_id", {
    "crumb": (lambda: F.array_join(F.transform(X.crumb_key("breadcrumb"), lambda x: x.cast("string")), ","), r"array_to_string(list_transform(regexp_extract_all(coalesce(breadcrumb, ''), '\d+'), lambda x: cast(x as bigint)), ',')"),
})
_both("scl_11", "definitions", "def_id", {"piped": (lambda: X.semicolons_to_pipes("definition"), r"regexp_replace(definition, ';\s?', '|', 'g')")})
_both("scl_12", "definitions", "def_id", {
    "number": (lambda: X.to_number("definition"), "try_cast(trim(definition) as double)"),
    "number_of_key": (lambda: F.expr("try_cast(concat(' ', def_id, '.5') as double)"), "try_cast(' ' || def_id || '.5' as double)"),
    "flag": (lambda: X.to_flag(F.col("source_id") % 3), "case when source_id % 3 = 1 then 1 else 0 end"),
})
_both("scl_13", "definitions", "def_id", {
    "parts": (lambda: F.array_join(X.split_clean("definition", "[.;,]"), "|"), "array_to_string(list_filter(list_transform(string_split_regex(coalesce(definition, ''), '[.;,]'), lambda x: trim(x)), lambda x: x <> ''), '|')"),
})
_both("scl_14", "definitions", "def_id", {
    "excerpt": (lambda: X.excerpt("definition", 60), r"""case when length(trim(regexp_replace(regexp_replace(string_split(definition, '|')[1], '\s*\p{Lu}{2,}[^.]*$', ''), '\s+', ' ', 'g'))) <= 60
      then trim(regexp_replace(regexp_replace(string_split(definition, '|')[1], '\s*\p{Lu}{2,}[^.]*$', ''), '\s+', ' ', 'g'))
      else regexp_replace(left(trim(regexp_replace(regexp_replace(string_split(definition, '|')[1], '\s*\p{Lu}{2,}[^.]*$', ''), '\s+', ' ', 'g')), 60), '\s+\S*$', '') || '…' end"""),
})
_both("scl_15", "definitions", "def_id", {
    "meta": (lambda: F.when(F.length("definition") > 0, F.concat("word", F.lit(": "), X.truncate("definition", 100))).otherwise(F.concat("word", F.lit(": fără definiție"))),
             "case when length(definition) > 0 then word || ': ' || case when length(definition) <= 100 then definition else left(definition, 99) || '…' end else word || ': fără definiție' end"),
})
_W = FOLD.format("word")
_NEED = f"cast(greatest(4, least(length(t), length({_W})) - 3) as int)"
_REVEALS = f"(length({_W}) >= 5 and len(list_filter(regexp_extract_all({FOLD.format('{}')}, '\\p{{L}}+'), lambda t: length(t) >= 4 and left(t, {_NEED}) = left({_W}, {_NEED}))) > 0)"
_both("scl_16", "definitions", "def_id", {"reveals": (lambda: X.reveals_word("definition", "word").cast("int"), f"cast(coalesce({_REVEALS.replace('{}', 'definition')}, false) as int)")})
_both("scl_17", "definitions", "def_id", {
    "usable": (lambda: F.size(X.usable_senses(F.translate("definition", ".;", "||"), "word")),
               "cast(len(list_filter(list_filter(list_transform(string_split(coalesce(translate(definition, '.;', '||'), ''), '|'), lambda x: trim(x)), lambda x: x <> ''), "
               r"lambda s: length(s) >= 12 and not regexp_matches(lower(trim(s)), '^(vezi|v\.)\s|^(diminutiv|augmentativ)') and not s like '%:' and not regexp_matches(s, '\p{Lu}{3}') and not coalesce("
               + _REVEALS.replace("{}", "s") + ", false))) as int)"),
})
_both("scl_18", "definitions", "def_id", {"pointer": (lambda: X.is_pointer("definition").cast("int"), r"cast(coalesce(regexp_matches(lower(trim(definition)), '^(vezi|v\.)\s|^(diminutiv|augmentativ)'), false) as int)")})
_both("scl_19", "form_lemma", "form_id", {"masked": (lambda: X.mask_word(F.concat("lemma", F.lit(", "), F.upper("lemma"), F.lit("!")), "lemma"), "case when lemma = '' then ', !' else '———, ———!' end")})
ORACLES["scl_19"] = "select distinct form_id, case when lemma is null then null else '———, ———!' end as masked from form_lemma"


def _scl_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's list of annotated words packed and unpacked again (words by the order of first change)."""
    a = read(spark, sf_dir, "annotations").where("word is not null and seq > 0")
    items = a.select("user_id", F.col("seq").alias("position"), F.col("seq").alias("word_id")).distinct()
    return codec.unpack_ids(codec.pack_ids(items, "user_id", "position", "word_id"), "user_id")


_add("scl_20", _scl_20, """
select user_id, cast(position as int) as position, word_id from (
  select user_id, seq as word_id, row_number() over (partition by user_id order by seq) - 1 as position
  from (select distinct user_id, seq from annotations where word is not null and seq > 0)) where position < 500""")  # fmt: skip
_both("scl_20_packed", "form_lemma", "form_id", {"code": (lambda: codec.to_base36(F.col("form_id")), "lower(to_base(form_id, 36))")})
_both("scl_21", "definitions", "def_id", {"slug": (lambda: X.slug("word"), f"regexp_replace(regexp_replace({_W}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")})


def _scl_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "annotations")
    t = F.when(F.col("seq") % 5 == 0, F.lit("demult")).otherwise(F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    c = X.clean_time(t, F.col("received_at").cast("timestamp"))
    return a.select("user_id", "seq", F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias("at")).distinct()


_add("scl_22", _scl_22, """
select distinct user_id, seq, strftime(case when seq % 5 = 0 or updated_at is null or date_trunc('millisecond', updated_at) > received_at + interval 60 second
  then date_trunc('millisecond', received_at) else date_trunc('millisecond', updated_at) end, '%Y-%m-%d %H:%M:%S.%g') as at from annotations""")  # fmt: skip


def _scl_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "annotations")
    dirty = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(" lol "), F.lit(""), F.repeat(F.lit("x"), F.lit(50)), F.coalesce("note", F.lit(""))))
    return a.select("user_id", "seq", F.array_join(X.clean_tags(dirty), "|").alias("tags")).distinct()


_TAGS = "list_transform(list_concat(coalesce(tags, []), [' lol ', '', repeat('x', 50), coalesce(note, '')]), lambda t: left(trim(t), 40))"
_add("scl_23", _scl_23, f"""
select distinct user_id, seq, array_to_string(list_filter(l, lambda t, i: t <> '' and list_position(l, t) = i), '|') as tags
from (select user_id, seq, {_TAGS} as l from annotations)""")  # fmt: skip
_both("scl_24", "corpus_word_frequency", "id", {
    "phrase": (lambda: X.count_phrase("document_count", "cuvânt", "cuvinte"),
               "case when document_count = 1 then '1 cuvânt' else document_count || case when document_count = 0 or document_count % 100 between 1 and 19 then ' ' else ' de ' end || 'cuvinte' end"),
})
# rules written out in SQL, apart from those of the operator
_LEFT = "(^|[^\\pL\\pN_])"
_BODY = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(definition, '\\([^)]*\\)', ' ', 'g'), '{_LEFT}v\\s*\\.\\s*[^,;.]+', '\\1 ', 'gi'), '{_LEFT}\\d+\\s*\\.', '\\1 ', 'g'),
  '{_LEFT}(?:adj|adv|s|sf|sm|sn|vb|vt|vi|interj|art|pron|prep|conj|num|pl|sg)\\s*\\.', '\\1 ', 'gi')"""
_PLAIN = "replace(replace(translate({}, 'áàéèíìóòúùÁÀÉÈÍÌÓÒÚÙ', 'aaeeiioouuAAEEIIOOUU'), chr(769), ''), chr(768), '')"
_add("scl_25", _on("definitions", "def_id", words=lambda: F.array_join(X.entry_words("definition", "word"), "|")), f"""
with d as (select distinct def_id, word, definition from definitions),
p as (select def_id, word, unnest(string_split_regex({_BODY}, '[,;.]')) as p, generate_subscripts(string_split_regex({_BODY}, '[,;.]'), 1) as i from d where definition is not null),
q as (select def_id, word, i, trim(regexp_replace(regexp_replace(s, '^[A-ZĂÂÎȘȚ][A-ZĂÂÎȘȚ0-9''\\- ]*\\s+', ''), '\\s+', ' ', 'g'), ' ') as w from (select *, trim({_PLAIN.format("p")}, ' ' || chr(9) || chr(10) || '-–—*≠~') as s from p) where not contains(s, '~')),
k as (select *, nfc_normalize(translate(lower(w), 'şţ', 'șț')) as k from q where regexp_matches(w, '[a-zăâîșț]') and length(w) <= 40 and len(string_split(w, ' ')) <= 4),
f as (select def_id, k, arg_min(w, i) as w, min(i) as i from k where length(k) >= 2 and k is distinct from nfc_normalize(translate(lower({_PLAIN.format("word")}), 'şţ', 'șț')) group by 1, 2)
select d.def_id, case when d.definition is null then null else coalesce(string_agg(w, '|' order by i), '') end as words from d left join f using (def_id) group by d.def_id, d.definition, d.word""")
_both("scl_26", "definitions", "def_id", {"plain": (lambda: X.strip_stress("word"), "replace(replace(translate(word, 'áàéèíìóòúùÁÀÉÈÍÌÓÒÚÙ', 'aaeeiioouuAAEEIIOOUU'), chr(769), ''), chr(768), '')")})
_both("scl_27", "definitions", "def_id", {
    "head": (lambda: X.entry_headword(F.concat(F.upper(F.regexp_replace("word", "[ﬁﬂﬆ]", "fl")), F.lit(" "), F.coalesce("definition", F.lit("")))),
             r"lower(replace(replace(translate(regexp_extract(trim(upper(regexp_replace(word, '[ﬁﬂﬆ]', 'fl', 'g')) || ' ' || coalesce(definition, ''), ' '), '^(\p{Lu}[\p{Lu}\-]*)', 1), 'áàéèíìóòúùÁÀÉÈÍÌÓÒÚÙ', 'aaeeiioouuAAEEIIOOUU'), chr(769), ''), chr(768), ''))"),
})


def _scl_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a word's articles those whose text begins with it, if there are any, else all."""
    d = read(spark, sf_dir, "definitions").select("def_id", "word", "definition").distinct()
    d = d.withColumn("own", F.coalesce(F.lower("definition").startswith(F.substring(F.lower("word"), 1, 1)), F.lit(False)))
    best = d.groupBy("word").agg(F.max("own").alias("any_own"))
    return d.join(best, "word").where("own or not any_own").select("def_id", "word")


_add("scl_28", _scl_28, """
with d as (select distinct def_id, word, definition, coalesce(starts_with(lower(definition), left(lower(word), 1)), false) as own from definitions)
select def_id, word from (select *, max(own) over (partition by word) as any_own from d where word is not null) where own or not any_own""")  # fmt: skip
_both("scl_29", "definitions", "def_id", {
    "dirty": (lambda: X.is_dirty_token("definition").cast("int"),
              r"cast((definition like '%=%' or length(definition) > 40 or len(string_split_regex(trim(definition), '\s+')) > 4 or (length(regexp_replace(definition, '[^\p{L}]', '', 'g')) > 0 and length(regexp_replace(definition, '[^\p{Lu}]', '', 'g')) * 2 > length(regexp_replace(definition, '[^\p{L}]', '', 'g')))) as int)"),
})


def _scl_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles set as pages and read back."""
    d = read(spark, sf_dir, "definitions").where("definition is not null and word is not null").select("def_id", "source_id", "definition").distinct()
    page = F.concat(
        F.lit('<html><div class="x">no</div><div class="defWrapper"><span class="def">'), X.html_escape("definition"),
        F.lit('</span><br><a class="ref" href="/sursa/s'), F.col("source_id").cast("string"), F.lit('">s</a></div></html>'),
    )
    got = d.select("def_id", html_entries()(page).alias("e"))
    return got.select("def_id", best_texts("e", [f"s{k}" for k in range(40)]).alias("text")).where("text is not null")


_add("scl_30", _scl_30, r"select distinct def_id, trim(regexp_replace(definition, '\s+', ' ', 'g')) as text from definitions where definition is not null and word is not null and trim(definition) <> '' and source_id between 0 and 39")


def _scl_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definition of a form: its own, else its lemma's with a note whose form it is."""
    f, d = read(spark, sf_dir, "form_lemma", "definitions")
    d = d.where("definition is not null").groupBy("word").agg(F.min("definition").alias("definition"))
    own, lem = d.withColumnRenamed("word", "form").withColumnRenamed("definition", "own"), d.withColumnRenamed("word", "lemma")
    got = f.select("form_id", "form", "lemma").distinct().join(own, "form", "left").join(lem, "lemma", "left")
    return got.select("form_id", F.coalesce("own", F.concat(F.lit("[formă a lui "), "lemma", F.lit("] "), "definition")).alias("definition"))


_add("scl_31", _scl_31, """
with d as (select word, min(definition) as definition from definitions where definition is not null group by word)
select f.form_id, coalesce(o.definition, '[formă a lui ' || f.lemma || '] ' || l.definition) as definition
from (select distinct form_id, form, lemma from form_lemma) f left join d o on o.word = f.form left join d l on l.word = f.lemma""")  # fmt: skip
FILE = r"^(\d{4})_([^_]+)_(.+)\.json$"
_NAME = "concat(coalesce(year, 1900), '_', translate(coalesce(author, 'Anonim'), '_', ' '), '_', coalesce(title, 'x'), '.json')"
_both("scl_33", "documents", "doc_id", {
    k: (lambda i=i: F.regexp_extract(F.expr(_NAME), FILE, i), f"regexp_extract({_NAME}, '{FILE}', {i})") for i, k in ((1, "file_year"), (2, "file_author"), (3, "file_title"))
})
_both("scl_34", "documents", "doc_id", {
    "found": (lambda: X.snippet_date(F.concat(F.substring(F.date_format("collected_at", "yyyy-MM-dd"), 1, 10), F.lit(" în "), F.coalesce(F.col("year").cast("string"), F.lit("")))),
              "coalesce(strftime(collected_at, '%Y-%m-%d'), '') || ''"),
})
ORACLES["scl_34"] = "select distinct doc_id, strftime(collected_at, '%Y-%m-%d') as found from documents"
_both("scl_35", "eval_items", "item_id", {
    "query": (lambda: F.concat_ws(" ", F.concat(F.lit('"'), F.translate(F.substring("text", 1, 30), "'’", ""), F.lit('"')), F.lit("-site:exemplu.ro")), "'\"' || translate(left(text, 30), '''’', '') || '\" -site:exemplu.ro'"),
})
TYPES = {"0": "sens", "1": "etimologie", "2": "citat", "3": "comentariu", "4": "compus", "5": "expresie"}
_both("scl_36", "meanings", "meaning_id", {
    "kind": (lambda: X.labels(F.col("type").cast("string"), TYPES, "?"), "case type " + " ".join(f"when {k} then '{v}'" for k, v in TYPES.items()) + " else '?' end"),
})
_both("scl_37", "corpus_word_frequency", "id", {
    "duration": (lambda: X.human_duration("occurrence_count"),
                 "case when occurrence_count is null then null when occurrence_count >= 3600 then printf('%dh %02dm', occurrence_count // 3600, occurrence_count % 3600 // 60) when occurrence_count >= 60 then printf('%dm %02ds', occurrence_count // 60, occurrence_count % 60) else occurrence_count || 's' end"),
    "thousands": (lambda: F.when(F.col("occurrence_count") < 1000, X.human_count("occurrence_count")), "case when occurrence_count < 1000 then occurrence_count || '' end"),
})
_NOW = "2026-01-01 00:00:00"
_AGO = f"cast(floor((epoch_us(timestamp '{_NOW}') - epoch_us(last_updated)) / 1000000) as bigint)"
_both("scl_37_all", "corpus_word_frequency", "id", {
    "short": (lambda: X.human_count("occurrence_count"),
              # format_string rounds halves up
              "case when occurrence_count >= 1000000000 then printf('%.1fB', round(occurrence_count / 1e9, 1)) when occurrence_count >= 1000000 then printf('%.1fM', round(occurrence_count / 1e6, 1)) when occurrence_count >= 1000 then printf('%.1fk', round(occurrence_count / 1e3, 1)) else occurrence_count || '' end"),
    "grouped": (lambda: X.grouped_count("occurrence_count"),
                "case when occurrence_count >= 1000000000 then printf('%.1fB', occurrence_count / 1e9) when occurrence_count >= 1000000 then printf('%.1fM', occurrence_count / 1e6) else format('{:,}', occurrence_count) end"),
    "size": (lambda: X.human_size("occurrence_count"),
             "case when occurrence_count < 1024 then occurrence_count || ' B' when occurrence_count < 1048576 then printf('%.1f KB', occurrence_count / 1024.0::double) when occurrence_count < 1073741824 then printf('%.1f MB', occurrence_count / 1048576.0::double) when occurrence_count < 1099511627776 then printf('%.1f GB', occurrence_count / 1073741824.0::double) when occurrence_count is not null then printf('%.1f TB', occurrence_count / 1099511627776.0::double) end"),
    "ago": (lambda: X.relative_time("last_updated", F.lit(_NOW)),
            f"case when {_AGO} < 60 then 'just now' when {_AGO} < 3600 then ({_AGO} // 60) || 'm ago' when {_AGO} < 86400 then ({_AGO} // 3600) || 'h ago' when {_AGO} is not null then ({_AGO} // 86400) || 'd ago' end"),
})
_both("scl_38", "definitions", "def_id", {"url": (lambda: X.page_url("https://exemplu.ro/cuvant/", "word"), "'https://exemplu.ro/cuvant/' || url_encode(word)")})


def _scl_39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a word's forms on a circle around it: equal angles, a radius that grows with their number."""
    f = read(spark, sf_dir, "form_lemma").where("lemma is not null").select("lemma", "form").distinct()
    n = f.groupBy("lemma").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("form")).alias("forms"))
    p = n.select("lemma", "n", F.posexplode("forms").alias("k", "form"))
    angle, radius = F.col("k") * F.lit(360.0) / F.col("n"), F.greatest(F.lit(80), F.least(F.lit(240), F.col("n") * 12))
    return p.select("lemma", "form", F.round(angle, 3).alias("angle"), radius.cast("int").alias("radius"))


_add("scl_39", _scl_39, """
select lemma, form, round((row_number() over (partition by lemma order by form) - 1) * 360.0::double / count(*) over (partition by lemma), 3) as angle,
  cast(greatest(80, least(240, count(*) over (partition by lemma) * 12)) as int) as radius
from (select distinct lemma, form from form_lemma where lemma is not null and form is not null)""")  # fmt: skip
_both("scl_40", "definitions", "def_id", {"label": (lambda: X.truncate("word", 16), "case when length(word) <= 16 then word else left(word, 15) || '…' end")})
_both("scl_41", "documents", "doc_id", {"size": (lambda: F.length(X.html_escape("text")).cast("long"), "cast(length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(translate(text, '<>', ''))) + 5 * (length(text) - length(replace(replace(text, '\"', ''), '''', ''))) as bigint)")})
_both("scl_42", "definitions", "def_id", {"token": (lambda: F.sha2("word", 256), "sha256(word)")})
_both("scl_43", "definitions", "def_id", {
    "header": (lambda: F.array_join(F.slice(X.split_clean("definition", r"\."), 1, 2), " | "),
               "array_to_string(list_slice(list_filter(list_transform(string_split(coalesce(definition, ''), '.'), lambda x: trim(x)), lambda x: x <> ''), 1, 2), ' | ')"),
})
QUERIES["src_14"], ORACLES["src_14"] = QUERIES["scl_30"], ORACLES["scl_30"]


def _udf_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function registered for SQL text: defined in SQL, so that it is inlined into the plan."""
    spark.sql("create or replace temporary function strip_diacritics(s string) returns string return translate(lower(s), 'țșţşăâî', 'tstsaai')")
    read(spark, sf_dir, "definitions").createOrReplaceTempView("lexoria_definitions")
    return spark.sql("select distinct def_id, strip_diacritics(word) as folded from lexoria_definitions")


_add("udf_01", _udf_01, f"select distinct def_id, {_W} as folded from definitions")
