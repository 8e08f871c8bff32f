"""Queries of the readers and writers: tables are rendered in an input's format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


from lexoria.operators.keyed import first_per_key, last_per_key
from lexoria.plans.runtime import publish, read, shared_dir
from lexoria.sources import dump, files, sinks

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TAG = {"id": (0, "long"), "parentId": (1, "long"), "value": (2, "string"), "color": (3, "int"), "tooltip": (6, "string")}
TAG_COLS = ["id", "parentId", "value", "color", "icon", "iconOnly", "tooltip", "public"]


@query("select distinct id, parentId, value, color, tooltip from tag")
def src_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples of a dump with only the first fields decoded."""
    lines = dump.render(read(spark, sf_dir, "tag"), "Tag", TAG_COLS)
    return dump.dump_table(lines, "Tag", TAG).distinct()


@query("select distinct def_id, nullif(trim(regexp_replace(definition, '\\s+', ' ', 'g'), ' '), '') as definition, word from definitions")
def src_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of a dump, white space collapsed, empty ones null."""
    lines = dump.render(read(spark, sf_dir, "definitions"), "Definition", ["def_id", "definition", "word"])
    return dump.dump_table(lines, "Definition", {"def_id": (0, "long"), "definition": (1, "string"), "word": (2, "string")}, collapse=True).distinct()


ORACLES["src_03"] = "select distinct def_id, nullif(trim(regexp_replace(definition, '\\s+', ' ', 'g'), ' '), '') as definition, nullif(trim(regexp_replace(word, '\\s+', ' ', 'g'), ' '), '') as word from definitions"


@query("select distinct def_id, source_id, definition from definitions where source_id in (1, 2)")
def src_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two sources, told by the undecoded tuple before its text is decoded."""
    lines = dump.render(read(spark, sf_dir, "definitions"), "Definition", ["def_id", "user_id", "source_id", "word", "definition"])
    cols = {"def_id": (0, "long"), "source_id": (2, "int"), "definition": (4, "string")}
    return dump.dump_table(lines, "Definition", cols, where=F.col("tuple").rlike(r"^\d+,\d+,(1|2),")).distinct()


@query("select n_fields, cast(count(*) as bigint) as n from (select 8 as n_fields from tag) group by n_fields")
def src_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of every row, positions kept, also where fields are null."""
    lines = dump.render(read(spark, sf_dir, "tag"), "Tag", TAG_COLS)
    return dump.tuples(lines, "Tag").select(F.size(dump.fields(F.col("tuple"))).alias("n_fields")).groupBy("n_fields").agg(F.count("*").alias("n"))


ALL_TAG = ["id", "parentId", "value", "color", "icon", "iconOnly", "tooltip", "public", "isPos", "createDate", "modDate"]


@query("select distinct id, unnest(range(0, 11)) as position, unnest([id || '', parentId || '', value, color || '', icon, iconOnly || '', tooltip, public || '', isPos || '', createDate || '', modDate || '']) as value from tag")
def src_05_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every row by its position, nulls too."""
    t = dump.tuples(dump.render(read(spark, sf_dir, "tag"), "Tag", ALL_TAG), "Tag").select(dump.fields(F.col("tuple")).alias("f"))
    t = t.select(dump.decode(F.col("f")[0]).cast("long").alias("id"), F.posexplode("f").alias("position", "field"))
    return t.select("id", F.col("position").cast("long").alias("position"), dump.decode(F.col("field")).alias("value")).distinct()


@query("select distinct meaning_id, tree_id, type from meanings")
def src_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of whole numbers only."""
    lines = dump.render(read(spark, sf_dir, "meanings"), "Relation", ["meaning_id", "tree_id", "type"])
    return dump.dump_table(lines, "Relation", {"meaning_id": (0, "long"), "tree_id": (1, "long"), "type": (2, "int")}).distinct()


@query("select distinct def_id, source_id, nullif(definition, '') as definition from definitions")
def src_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with quotes and commas in its cells, written and read back."""
    d = read(spark, sf_dir, "definitions").select("def_id", "source_id", "definition").distinct()
    path = f"{shared_dir(spark)}/lexoria-csv-{spark.sparkContext.applicationId}"
    sinks.write_csv(d, path)
    return files.read_csv(spark, path, "def_id long, source_id int, definition string")


_LIST = "concat(word, '\t', coalesce(occurrence_count, -1), case when document_count is null then '\tx' else '' end)"


@query("""
select word, cast(sum(n) as bigint) as count from (
  select nullif(trim(nfc_normalize(translate(lower(word), 'şţ', 'șț')), ' '), '') as word, coalesce(occurrence_count, -1) as n
  from (select distinct on (id) * from corpus_word_frequency) where document_count is not null and word is not null)
where word is not null group by word""")
def src_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word list of two columns; broken lines are counted, words that normalize alike are summed."""
    rows = read(spark, sf_dir, "corpus_word_frequency").dropDuplicates(["id"])
    counts, _ = files.frequency_lines(rows.select(F.expr(_LIST).alias("value")).where("value is not null"))
    return counts


@query("select year, author, nullif(title, '') as title, length(text) + 3 as n_chars, count(*) as n from (select distinct doc_id, cast(coalesce(year, 1900) as int) as year, coalesce(author, 'Anonim') as author, coalesce(title, 'x') as title, coalesce(text, '') as text from documents) group by all")
def src_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novels as JSON of chapters and paragraphs, with year, author and title in the file's name."""
    d = read(spark, sf_dir, "documents").select("doc_id", "year", "author", "title", "text").distinct()
    path = F.expr("concat('/n/', coalesce(year, 1900), '_', coalesce(author, 'Anonim'), '_', coalesce(title, 'x'), '.json')")
    content = F.to_json(F.create_map(F.lit("cap. 1"), F.array(F.coalesce("text", F.lit(""))), F.lit("cap. 2"), F.array(F.lit("x"), F.lit(""))))
    got = files.novels(d.select(path.alias("path"), content.alias("value")))
    return got.groupBy("year", "author", "title", F.length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("n"))


@query("select count(*) as n_docs, cast(sum(coalesce(length(text), 0)) as bigint) as n_chars from documents")
def src_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column of Parquet shards, the others not read."""
    t = files.shard_texts(spark, f"{sf_dir}/documents.parquet")
    return t.agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))


@query("""
select a.word, a.n_marks, c.occurrences from (select word, count(*) as n_marks from annotations where word is not null group by word) a
join (select word, cast(sum(occurrence_count) as bigint) as occurrences from (select distinct on (id) * from corpus_word_frequency) group by word) c using (word)""")
def src_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join across two stores: marks of the user store and counts of the corpus store."""
    a, c = read(spark, sf_dir, "annotations", "corpus_word_frequency")
    marks = a.where("word is not null").groupBy("word").agg(F.count("*").alias("n_marks"))
    return marks.join(c.dropDuplicates(["id"]).groupBy("word").agg(F.sum("occurrence_count").alias("occurrences")), "word")


@query("select form as name, arg_max(lemma, form_id) as value from (select distinct form_id, form, coalesce(lemma, '') as lemma from form_lemma where trim(form, ' ') <> '' and form not like '#%') group by form")
def src_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of names and values with comments and blank lines; the last line of a name counts."""
    f = read(spark, sf_dir, "form_lemma")
    lines = f.select("form_id", F.concat_ws("\t", "form", F.coalesce("lemma", F.lit(""))).alias("value"))
    lines = lines.unionByName(f.select("form_id", F.concat(F.lit("# "), "form").alias("value"))).unionByName(f.select("form_id", F.lit("  ").alias("value")))
    return files.registry(lines, "form_id")


ORACLES["src_13"] = "select trim(form, ' ') as name, arg_max(trim(lemma, ' '), form_id) as value from (select distinct form_id, form, coalesce(lemma, '') as lemma from form_lemma where trim(form, ' ') <> '') group by 1"


@query("select nfc_normalize(translate(lower(trim(word, ' ')), 'şţ', 'șț')) as headword, def_id || '' as target from (select distinct def_id, word from definitions where word is not null)")
def src_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON index of headwords and ids."""
    d = read(spark, sf_dir, "definitions").where("word is not null").select("def_id", "word").distinct()
    pair = F.array(F.concat("word", F.lit("|s.n.")), F.col("def_id").cast("string"))
    pages = d.groupBy(F.floor(F.col("def_id") / 500).alias("p")).agg(F.to_json(F.collect_list(pair)).alias("value"))
    return files.cross_references(pages)


@query("""
select line, name from (select *, row_number() over (partition by name order by line) - 1 as k from (
  select def_id as line, case source_id % 4 when 0 then 'Definition' when 1 then 'Tree' when 2 then 'History' else '' end as name from (select distinct def_id, source_id from definitions)))
where name in ('', 'Definition') or (name = 'Tree' and k % 10 = 0)""")
def src_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump's sample: some tables whole, some left out, of the others every tenth insert."""
    d = read(spark, sf_dir, "definitions").select("def_id", "source_id").distinct()
    name = F.when(F.col("source_id") % 4 == 0, "Definition").when(F.col("source_id") % 4 == 1, "Tree").when(F.col("source_id") % 4 == 2, "History").otherwise("")
    lines = d.select(F.col("def_id").alias("line"), F.when(name == "", F.lit("-- x")).otherwise(F.concat(F.lit("INSERT INTO `"), name, F.lit("` VALUES (1);"))).alias("value"))
    got = dump.sample_lines(lines, "line", {"Definition"}, {"History"})
    return got.select("line", F.regexp_extract("value", "`([^`]+)`", 1).alias("name"))


@query("select word, arg_min(def_id, def_id) as def_id, arg_min(source_id, def_id) as source_id from (select distinct def_id, word, source_id from definitions) where word is not null group by word")
def snk_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key stays."""
    d = read(spark, sf_dir, "definitions").where("word is not null").select("word", "def_id", "source_id")
    return first_per_key(d, ["word"], ["def_id"])


@query("select word, max(def_id) as def_id, arg_max(source_id, def_id) as source_id from (select distinct def_id, word, source_id from definitions) where word is not null group by word")
def snk_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key replaces the others."""
    d = read(spark, sf_dir, "definitions").where("word is not null").select("word", "def_id", "source_id")
    return last_per_key(d, ["word"], ["def_id"])


@query("""
select word, cast(sum(coalesce(occurrence_count, 0)) as bigint) as occurrence_count, cast(sum(coalesce(document_count, 0)) as bigint) as document_count, strftime(max(last_updated), '%Y-%m-%d %H:%M:%S') as last_updated
from (select distinct on (id) * from corpus_word_frequency) where word is not null group by word""")
def snk_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts added to a stored table, corpus after corpus; the time is the latest."""
    c = read(spark, sf_dir, "corpus_word_frequency").dropDuplicates(["id"]).where("word is not null")
    c = c.select("word", "corpus_name", F.coalesce("occurrence_count", F.lit(0)).alias("occurrence_count"), F.coalesce("document_count", F.lit(0)).alias("document_count"), "last_updated")
    old = publish(sinks.merge_counts(c.where("corpus_name <> 'web_azi'"), ["word"], ["occurrence_count", "document_count"], ["last_updated"]), "counts")
    new = c.where("corpus_name = 'web_azi' or corpus_name is null").drop("corpus_name")
    got = sinks.merge_counts(old.unionByName(new.select(*old.columns)), ["word"], ["occurrence_count", "document_count"], ["last_updated"])
    return got.withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss"))


@query("select distinct on (id) id, word, corpus_name, case when corpus_name = 'carti_scanate' then occurrence_count * 2 else occurrence_count end as occurrence_count, case when corpus_name = 'carti_scanate' then 0 else document_count end as document_count from corpus_word_frequency where corpus_name is not null")
def snk_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corpus replaced whole, its document counts unknown (0); the others stay. Partitions of a stored table."""
    c = read(spark, sf_dir, "corpus_word_frequency").dropDuplicates(["id"]).where("corpus_name is not null")
    c = c.select("id", "word", "corpus_name", "occurrence_count", "document_count")
    path = f"{shared_dir(spark)}/lexoria-corpora-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    sinks.replace_partitions(c, path, "corpus_name")
    new = c.where("corpus_name = 'carti_scanate'").withColumns({"occurrence_count": F.col("occurrence_count") * 2, "document_count": F.lit(0).cast("long")})
    sinks.replace_partitions(publish(new, "one-corpus"), path, "corpus_name")
    return spark.read.schema(c.schema).parquet(path)


@query("select distinct on (id) id, printf('%.2f', occurrence_count * 1.0::double) as occurrences, printf('%.4f', document_count * 0.5::double) as half from corpus_word_frequency where occurrence_count is not null and document_count is not null")
def snk_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with fixed decimals."""
    c = read(spark, sf_dir, "corpus_word_frequency").dropDuplicates(["id"]).where("occurrence_count is not null and document_count is not null")
    return sinks.fixed(c.select("id", F.col("occurrence_count").alias("occurrences"), (F.col("document_count") * 0.5).alias("half")), {"occurrences": 2, "half": 4})


@query("select source_id, count(*) as n from (select distinct def_id, source_id from definitions) group by source_id")
def snk_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of one JSON object per line, appended to and read back."""
    d = read(spark, sf_dir, "definitions").select("def_id", "source_id").distinct()
    path = f"{shared_dir(spark)}/lexoria-history-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    if sinks.exists(spark, path):
        sinks.remove(spark, path)
    for part in (d.where("source_id is null"), d.where("source_id is not null")):
        sinks.append_history(part, path)
    return spark.read.json(path, schema="def_id long, source_id int").groupBy("source_id").agg(F.count("*").alias("n"))


@query("select '- ' || corpus_name || ': ' || count(*) as line from (select distinct on (id) * from corpus_word_frequency) where corpus_name is not null group by corpus_name")
def snk_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report."""
    c = read(spark, sf_dir, "corpus_word_frequency").dropDuplicates(["id"]).where("corpus_name is not null")
    return c.groupBy("corpus_name").agg(F.count("*").alias("n")).select(F.format_string("- %s: %d", "corpus_name", "n").alias("line"))


@query("select doc_id, strftime(collected_at, '%Y-%m-%d') as day from (select distinct doc_id, collected_at from documents) order by collected_at desc nulls last, doc_id || '' desc limit 14")
def snk_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 14 of a listing."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "collected_at").distinct()
    return sinks.keep_newest(d, "collected_at", "name", 14).select(F.col("name").cast("long").alias("doc_id"), F.date_format("collected_at", "yyyy-MM-dd").alias("day"))


@query("""select word, '[' || string_agg('{"def_id":' || def_id || ',"source_id":' || source_id || '}', ',' order by def_id) || ']' as json from (select distinct def_id, word, source_id from definitions) where word is not null and source_id is not null group by word""")
def snk_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each word as one JSON text."""
    d = read(spark, sf_dir, "definitions").where("word is not null and source_id is not null").select("word", "def_id", "source_id").distinct()
    return sinks.json_store(d, "word", ["def_id", "source_id"])


QUERIES["srt_13"], ORACLES["srt_13"] = snk_11, ORACLES["snk_11"]


@query("select distinct def_id, word from definitions")
def snk_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table dropped and built anew."""
    d = read(spark, sf_dir, "definitions").select("def_id", "word").distinct()
    path = f"{shared_dir(spark)}/lexoria-rebuilt-{spark.sparkContext.applicationId}"
    for old in (d.where("word is null"), d):
        sinks.replace_table(old, path)
    return sinks.read_table(spark, path)


@query("select 1 as refused, count(distinct def_id) as n from definitions")
def snk_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is there already isn't overwritten by accident."""
    d = read(spark, sf_dir, "definitions").select("def_id").distinct()
    path = f"{shared_dir(spark)}/lexoria-guarded-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    if sinks.exists(spark, path):
        sinks.remove(spark, path)
    sinks.create_table(d, path)
    refused = 0
    try:
        sinks.create_table(d.limit(0), path)
    except AnalysisException:
        refused = 1
    return spark.read.schema(d.schema).parquet(path).agg(F.lit(refused).alias("refused"), F.count("*").alias("n"))
