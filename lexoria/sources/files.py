"""Readers of the other inputs: CSV, word lists, novels in JSON, registries, indexes, Parquet shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.functions import text as X
from lexoria.operators.rank import global_rank


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; the schema is given, never guessed. Empty cells are null."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)


def frequency_lines(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(word, count) summed by normalized word, and one row (rows, malformed).

    Malformed is a line without exactly two parts, a whole number and a word.
    """
    p = F.split(F.col(text), "\t")
    rows = lines.select(
        F.nullif(F.trim(X.normalize(F.try_element_at(p, F.lit(1)))), F.lit("")).alias("word"),
        F.try_element_at(p, F.lit(2)).try_cast("long").alias("n"),
        (F.size(p) == 2).alias("two"),
    )
    ok = F.col("two") & F.col("word").isNotNull() & F.col("n").isNotNull()
    counts = rows.where(ok).groupBy("word").agg(F.sum("n").alias("count"))
    return counts, rows.agg(F.count("*").alias("rows"), F.count_if(~ok).alias("malformed"))


# Fixed value: names of files of novels, year_author_title.json.
NOVEL_FILE = r"(\d{4})_([^_/]+)_([^/]+)\.json$"


def novels(files: DataFrame, path: str = "path", content: str = "value") -> DataFrame:
    """(year, author, title, text) of files of {chapter: [paragraph]}; the text is all paragraphs in order
    of chapters as they stand, joined by blanks; the rest comes from the file's name, '' being null."""
    paragraphs = F.flatten(F.map_values(F.from_json(F.col(content), "map<string,array<string>>")))
    part = lambda i: F.nullif(F.regexp_extract(F.col(path), NOVEL_FILE, i), F.lit(""))
    return files.select(part(1).cast("int").alias("year"), part(2).alias("author"), part(3).alias("title"), F.array_join(paragraphs, " ").alias("text"))


def registry(lines: DataFrame, order: str, text: str = "value") -> DataFrame:
    """(name, value) of lines 'name<TAB>value'; blank lines and those that begin with # are left out, of
    repeated names the last line counts."""
    t = F.trim(F.col(text))
    rows = lines.where((t != "") & ~t.startswith("#")).select(
        F.trim(F.substring_index(F.col(text), "\t", 1)).alias("name"),
        F.trim(F.when(F.col(text).contains("\t"), F.regexp_replace(F.col(text), r"^[^\t]*\t", "")).otherwise("")).alias("value"),
        F.col(order).alias("_o"),
    )
    return rows.where("name <> ''").groupBy("name").agg(F.max_by("value", "_o").alias("value"))


def cross_references(pages: DataFrame, content: str = "value") -> DataFrame:
    """(headword, target) of a JSON index [[headword, id], ...]; a headword ends at '|'."""
    pair = F.explode(F.from_json(F.col(content), "array<array<string>>"))
    rows = pages.select(pair.alias("p")).where(F.size("p") >= 2)
    return rows.select(X.normalize(F.trim(F.substring_index(F.col("p")[0], "|", 1))).alias("headword"), F.col("p")[1].alias("target"))


def shard_texts(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """One column of a folder of Parquet shards, with the shard's name; nothing else is read."""
    return spark.read.parquet(path).select(F.col(column).alias("text"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard"))


def skip_and_limit(df: DataFrame, order: list, skip: int, limit: int | None = None) -> DataFrame:
    """The rows after the first `skip` in an order, at most `limit` of them: how a run over a collection goes
    on where another stopped. No task sorts the whole."""
    place = global_rank(df, order, "_place")
    kept = place.where(F.col("_place") > skip)
    return (kept if limit is None else kept.where(F.col("_place") <= skip + limit)).drop("_place")
