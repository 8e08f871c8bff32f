"""Rows of a SQL dump, one multi-row INSERT statement per line, as columns.

Splitting is native: one pattern cuts a line into tuples, one a tuple into fields. Both are possessive,
so that a long line with long texts can't make them backtrack. Only the wanted fields are decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grammar of tuples and fields.
TUPLE = r"\(((?:[^'()]++|'[^'\\]*+(?:\\.[^'\\]*+)*+')*+)\)"
FIELD = r"('[^'\\]*+(?:\\.[^'\\]*+)*+'|[^,']+)"


def tuples(lines: DataFrame, table: str, text: str = "value") -> DataFrame:
    """(tuple) for each row inserted into `table`; lines of other tables and broken ones give nothing."""
    prefix = f"INSERT INTO `{table}` VALUES "
    body = F.substring(F.col(text), len(prefix) + 1, 2_000_000_000)
    return lines.where(F.col(text).startswith(prefix)).select(F.explode(F.regexp_extract_all(body, F.lit(TUPLE), F.lit(1))).alias("tuple"))


def fields(tuple_: Column) -> Column:
    return F.regexp_extract_all(tuple_, F.lit(FIELD), F.lit(1))


def decode(field: Column, collapse: bool = False) -> Column:
    """A field's value. Unquoted NULL is null, `\\x` in quotes is x.

    With `collapse`, `\\n`, `\\r` and `\\t` are white space, runs of white space become one blank, and
    empty texts and 'NULL' in quotes become null too.
    """
    quoted = field.startswith("'")
    inner = F.substr(field, F.lit(2), F.length(field) - 2)
    if collapse:
        inner = F.regexp_replace(inner, r"(?<!\\)((?:\\\\)*)\\[nrt]", "$1 ")
    plain = F.regexp_replace(inner, r"(?s)\\(.)", "$1")
    bare = F.trim(field)
    value = F.when(quoted, plain).when(F.upper(bare) != "NULL", bare)
    if collapse:
        value = F.trim(F.regexp_replace(value, r"\s+", " "))
        value = F.when((value != "") & (F.upper(value) != "NULL"), value)
    return value


def dump_table(lines: DataFrame, table: str, columns: dict[str, tuple[int, str]], text: str = "value", collapse: bool = False, where: Column | None = None) -> DataFrame:
    """The columns named, each by (index, type), of a table's rows; a short tuple gives nulls at its end.

    `where` is a condition on `tuple`, the undecoded row, and is tested before anything is decoded.
    A value that isn't of its type is null.
    """
    t = tuples(lines, table, text)
    if where is not None:
        t = t.where(where)
    t = t.select(fields(F.col("tuple")).alias("f"))
    value = lambda i: decode(F.try_element_at("f", F.lit(i + 1)), collapse)
    return t.select(*[(value(i) if kind == "string" else value(i).try_cast(kind)).alias(c) for c, (i, kind) in columns.items()])


def sample_lines(lines: DataFrame, order: str, keep: set[str], skip: set[str], every: int = 10, text: str = "value") -> DataFrame:
    """All lines of `keep` tables and those that aren't inserts, none of `skip` tables, and every
    `every`-th insert of each other table, by its place in the order of column `order`."""
    name = F.regexp_extract(F.col(text), r"^INSERT INTO `([^`]+)`", 1)
    rows = lines.withColumn("_table", name).where(~F.col("_table").isin(list(skip)) if skip else F.lit(True))
    whole = rows.where((F.col("_table") == "") | F.col("_table").isin(list(keep))).drop("_table")
    from lexoria.operators.rank import global_rank

    rest = rows.where((F.col("_table") != "") & ~F.col("_table").isin(list(keep)))
    part = global_rank(rest, [order], "_nth", within=["_table"]).where((F.col("_nth") - 1) % every == 0).drop("_table", "_nth")
    return whole.unionByName(part.select(*whole.columns))


def render(df: DataFrame, table: str, columns: list[str], per_line: int = 50) -> DataFrame:
    """Rows as INSERT lines (value), the opposite of `dump_table`; used to hand tables to such readers."""
    field = lambda c: F.coalesce(
        F.concat(F.lit("'"), F.regexp_replace(F.col(c), r"(['\\])", r"\\$1"), F.lit("'")) if dict(df.dtypes)[c] == "string" else F.col(c).cast("string"), F.lit("NULL")
    )
    row = F.concat(F.lit("("), F.concat_ws(",", *[field(c) for c in columns]), F.lit(")"))
    packed = df.select(row.alias("row"), F.pmod(F.xxhash64(*columns), F.lit(max(1, df.count() // per_line))).alias("line"))
    return packed.groupBy("line").agg(F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), F.array_join(F.collect_list("row"), ","), F.lit(";")).alias("value")).select("value")
